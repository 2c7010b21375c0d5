"""Token counts kept by deltas.

A batch is a set of signed counts: inserts add, deletes subtract, a revision subtracts the old count and adds
the new one. Batches are summed per source, language and tokenizer version before they are written, and
totals are the sums of all committed batches. A batch has an id; committing it again changes nothing.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.llm.common import tasks_of
from cinderspark.llm.tokens import with_ids

KEYS = ["source", "lang", "tokenizer"]
SIGNED = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def document_counts(
    docs: DataFrame, expressions: dict[str, Callable[[Column], Column]], files: dict[str, str], keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep``, ``source``, ``lang``, ``tokenizer``, ``n_tokens``: a row per document and tokenizer version, which is
    either a Spark expression of the text or a file of the tokenizers library. A null text has no tokens;
    null sources and languages are groups of their own."""
    counted = docs.select(*keep, "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    columns = {}
    for k, (version, expression) in enumerate(expressions.items()):
        columns[version] = f"_n{k}"
        counted = counted.withColumn(f"_n{k}", expression(F.col("text")).cast("bigint"))
    for k, (version, path) in enumerate(files.items(), len(columns)):
        ids = with_ids(counted, path, keys=tuple(counted.columns))
        columns[version] = f"_n{k}"
        counted = ids.withColumn(f"_n{k}", F.floor(F.octet_length("ids") / 4).cast("bigint")).drop("ids")
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("n_tokens")) for v, c in columns.items()])
    return counted.select(*keep, "source", "lang", F.inline(each))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("bigint").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that change, also from one source or language to another."""
    return deletes(before).unionByName(inserts(after))


class Ledger:
    """Committed batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, batch: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{batch}")

    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Batches whose writing ended: Spark marks them when all tasks have committed."""
        if not self._store().exists(self._path("")):
            return []
        names = [status.getPath().getName() for status in self._store().listStatus(self._path(""))]
        return sorted(n for n in names if self._store().exists(self._path(f"{n}/_SUCCESS")))

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Add the sums of signed counts; False if the batch is there already. What an attempt that broke off has
        left is written over."""
        if batch in self.committed():
            return False
        rows = self.spark.createDataFrame([], SIGNED)
        for change in changes:
            rows = rows.unionByName(change)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 OR n_tokens <> 0").coalesce(max(1, tasks_of(self.spark) // 8)).write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens`` over all committed batches; groups without documents go."""
        paths = [f"{self.folder}/{batch}" for batch in self.committed()]
        rows = self.spark.read.schema(SIGNED).parquet(*paths) if paths else self.spark.createDataFrame([], SIGNED)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")
