"""From raw documents to packed training sequences: language ID, near-duplicates, repeated passages, the mix of
sources, packing. Every stage takes (spark, docs, sf_dir); its result is written and read again as the next
one's documents. All but the last return the columns of the documents."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.llm.common import BATCH_ROWS, Scratch, bundled, unbundled
from cinderspark.llm.langid import UNKNOWN, train, with_language
from cinderspark.llm.minhash import NearDuplicates, near_duplicates
from cinderspark.llm.mixing import Mix, mix_sources
from cinderspark.llm.packing import pack_documents
from cinderspark.llm.suffix import Repeats, texts_without_repeats
from cinderspark.llm.tokens import default_tokenizer
from cinderspark.session import shared_folder

# A probability below this is no language; texts of a few letters still reach it.
LEAST_SCORE = 0.4
# Long enough that most documents lie in a block or two.
MIX = Mix(block=1024)
# Documents of a source whose copies are rounded along one running sum.
ROUNDED = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that name their language; drops texts without a letter or a clear language."""
    predicted = with_language(bundled(docs, "text"), train(docs))
    kept = predicted.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return unbundled(kept, docs.columns, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: of each group one row stays, that of the smallest doc_id (rows without
    an id count last). Rows without a shingle stay.

    Rows are told apart by a hash of id and text, so that one that shares its doc_id has a decision of its own and
    those without an id take part. Rows that agree in both are one document, of which any row stays.
    """
    scratch = Scratch(spark, "near-rows")
    rows = bundled(docs, "doc_id", "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    decided = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), NearDuplicates(words=5, percent=80))
    decided = decided.groupBy(F.col("doc_id").alias("_row")).agg(
        F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component")
    )
    decided = scratch.keep(decided, "decided")
    ids = rows.groupBy("_row").agg(F.min("doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "n")
    best = decided.where("n_shingles > 0").join(ids, "_row").groupBy("component").agg(F.min(order).alias("best"))
    stay = best.select("best._row", "best.n").unionByName(decided.where("n_shingles = 0").select("_row", F.lit(1).cast("bigint").alias("n")))
    stay = scratch.keep(stay, "stay")
    single = rows.join(stay.where("n = 1"), "_row", "left_semi")
    repeated = stay.where("n > 1")
    if not repeated.isEmpty():
        single = single.unionByName(rows.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))
    return unbundled(single, docs.columns, "doc_id", "text")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any 200-byte string that occurs again; documents stay, even with nothing left."""
    return texts_without_repeats(docs, Repeats(span=200))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: the whole part of taken / size, and some once more.
    Documents the mix doesn't take are gone.

    Which ones come once more is rounded along running sums: in rising size, the fractions of a source are added up from a
    seeded start, and a document that takes the sum over a whole number gets a copy. As neighbours are of
    like size, the words of a part differ from what the mix takes by two documents at most. Parts of a source hold about ROUNDED
    documents.
    """
    scratch = Scratch(spark, "mix-copies")
    taken = mix_sources(docs, MIX).groupBy("doc_id").agg(F.min("source").alias("_source"), F.sum("size").alias("_size"), F.sum("taken").alias("_taken"))
    taken = scratch.keep(taken, "taken")
    parts = taken.groupBy("_source").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROUNDED)).alias("_parts")).withColumnRenamed("_source", "_s")
    times = F.coalesce(F.try_divide("_taken", "_size"), F.lit(0.0))
    split = taken.join(parts, F.col("_source").eqNullSafe(F.col("_s"))).withColumns(
        {"_part": F.pmod(F.xxhash64("doc_id", F.lit(MIX.seed + 4)), F.col("_parts")), "_whole": F.floor(times), "_rest": times - F.floor(times)}
    )
    start = F.pmod(F.xxhash64("_source", "_part", F.lit(MIX.seed + 3)), F.lit(1 << 30)) / float(1 << 30)
    rising = Window.partitionBy("_source", "_part").orderBy("_size", F.xxhash64("doc_id", F.lit(MIX.seed + 3)), "doc_id")
    summed = split.withColumn("_sum", start + F.sum("_rest").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    once_more = F.floor("_sum") - F.floor(F.coalesce(F.lag("_sum").over(rising), start))
    copies = summed.select(F.col("doc_id").alias("_id"), (F.col("_whole") + once_more).cast("int").alias("_copies"))
    joined = bundled(docs, "doc_id", "text").join(copies.where("_copies > 0"), F.col("doc_id").eqNullSafe(F.col("_id")))
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return unbundled(repeated, docs.columns, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_documents(docs, default_tokenizer(), capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

# Models, hashes and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder before the next reads it."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Python stages get few rows at a time, as whole texts stand in them.
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            result = stage(spark, docs, sf_dir)
            result.write.parquet(f"{folder}/{name}")
            docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(setting, before)
    return docs
