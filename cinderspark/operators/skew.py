"""Joins and global orders that stay balanced when one key holds a large share of the rows."""

from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of one key that a single task should take; hotter keys are split.
ROWS_PER_SALT = 1_000_000
KEYLESS_SALTS = 4096

# Columns that name a row.
ROW_IDS = ["pid", "_id"]


def lookup(
    big: DataFrame, table: DataFrame, on: list[str], how: str = "left", rows_per_salt: int = ROWS_PER_SALT, counted: DataFrame | None = None
) -> DataFrame:
    """Join ``big`` to ``table``, which has one row or a few rows per key.

    Keys of ``big`` with more than ``rows_per_salt`` rows are split into salts, and only their rows of
    ``table`` are repeated. At most rows(big) / rows_per_salt keys can be that hot, which bounds the
    broadcast list of hot keys. Rows without a key match nothing and are spread. When the whole table is
    known to be small the planner's own size check turns the join into a broadcast one. Rows are spread by
    their id where they have one, so that no other column has to be read for it.

    ``counted`` may name a frame that is cheaper to read and has the keys of ``big`` as often, such as the
    points ``big`` was made of by earlier lookups.
    """
    keys = (big if counted is None else counted).select(*on).dropna()
    hot = (
        keys.groupBy(*on)
        .count()
        .where(F.col("count") > rows_per_salt)
        .select(*on, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts"))
    )
    split = F.coalesce(F.col("_salts"), F.lit(1))
    hashed = [c for c in ROW_IDS if c in big.columns] or [f.name for f in big.schema.fields if f.dataType.typeName() != "map"]
    spot = F.xxhash64(*hashed)
    keyless = reduce(or_, [F.col(key).isNull() for key in on])
    salted = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod(spot, F.when(keyless, F.lit(KEYLESS_SALTS)).otherwise(split)).cast("int"))
        .drop("_salts")
    )
    spread = (
        table.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), split - 1)))
        .drop("_salts")
    )
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def range_splits(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Edges of about equal buckets of a numeric column, open at both ends."""
    steps = [i / buckets for i in range(1, buckets)]
    inner = df.approxQuantile(column, steps, 1.0 / (10 * buckets)) if steps else []
    return [float("-inf"), *sorted(set(inner)), float("inf")]


def default_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_bucket(df: DataFrame, column: str, splits: list[float]) -> DataFrame:
    return Bucketizer(splits=splits, inputCol=column, outputCol="_bucket", handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    by: list[str] | None = None,
    ties: list[str] | None = None,
    splits: list[float] | None = None,
    placed: bool = False,
) -> DataFrame:
    """Add, for each ``{out: in}`` of ``sums``, the running sum of ``in`` in rising ``order``.

    The order is global (per ``by``), yet no task sees more than one value range: sums run inside
    ranges, and each range starts from the total of the ranges before it. The table of range totals has
    one row per range and ``by`` key; ``by`` must have few values (a label, a feature name).
    ``order`` with ``ties`` must be a total order. ``placed`` says that ``_bucket`` is there already, rising with
    ``order`` for each ``by`` key, so that keys can have ranges of their own.
    """
    by, ties = by or [], ties or []
    bucketed = df if placed else with_bucket(df, order, splits or range_splits(df, order, default_buckets(df)))
    totals = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums]
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed
    for out, c in sums.items():
        local = local.withColumn(out, F.sum(c).over(inside))
    joined = local.join(F.broadcast(offsets), [*by, "_bucket"])
    return joined.withColumns({out: F.col(out) + F.col(f"_o_{out}") for out in sums}).drop(
        "_bucket", *[f"_o_{out}" for out in sums]
    )


def grand_totals(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """One-row frame of sums, for a broadcast to every row."""
    return df.agg(*[F.sum(c).alias(out) for out, c in sums.items()])
