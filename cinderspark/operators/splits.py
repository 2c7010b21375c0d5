"""Train/test splits in time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.operators.quantiles import exact_quantiles


def split_instant(df: DataFrame, date: str = "date", share: float = 0.8) -> float | None:
    """Linear quantile of the instants, in microseconds."""
    micros = df.select(F.unix_micros(F.col(date).cast("timestamp")).cast("double").alias("us"))
    return exact_quantiles(micros, ["us"], [share])["us"][0]


def temporal_split(df: DataFrame, date: str = "date", share: float = 0.8, at: str | None = None) -> DataFrame:
    """Add ``in_train``: before the split instant, which is a given date or a quantile of the dates."""
    instant = F.unix_micros(F.col(date).cast("timestamp"))
    if at is not None:
        return df.withColumn("in_train", instant < F.unix_micros(F.lit(at).cast("timestamp")))
    return df.withColumn("in_train", instant < F.lit(split_instant(df, date, share)))


def split_report(df: DataFrame, date: str = "date") -> DataFrame:
    """(in_train, n, pct, first_day, last_day)."""
    sides = df.groupBy("in_train").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    return sides.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
