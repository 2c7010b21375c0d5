"""Checks and summaries of detections and feature matrices."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.functions.grid import strictly_within
from cinderspark.functions.risk import feature_category
from cinderspark.params import Box
from cinderspark.schemas import REQUIRED_DETECTION_COLUMNS


def detection_summary(d: DataFrame) -> DataFrame:
    """Count, date range and bounds in one row."""
    return d.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("acq_date").alias("first_day"),
        F.max("acq_date").alias("last_day"),
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
    )


def detection_breakdown(d: DataFrame) -> DataFrame:
    """Counts by satellite, by confidence and by year in one pass: (kind, value, n)."""
    keyed = d.select("satellite", F.col("confidence").cast("string").alias("confidence"), F.year("acq_date").cast("string").alias("year"))
    sets = keyed.groupingSets([["satellite"], ["confidence"], ["year"]], "satellite", "confidence", "year").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n")
    )
    kind = F.when(F.col("_g") == 3, "satellite").when(F.col("_g") == 5, "confidence").otherwise("year")
    value = F.when(F.col("_g") == 3, F.col("satellite")).when(F.col("_g") == 5, F.col("confidence")).otherwise(F.col("year"))
    return sets.select(kind.alias("kind"), value.alias("value"), "n")


def missing_rates(df: DataFrame, limit_pct: float = 10.0) -> DataFrame:
    """(column, missing_pct, flagged) of every column."""
    rates = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
    long = rates.unpivot([], df.columns, "column", "missing_pct")
    return long.withColumn("flagged", F.col("missing_pct") > limit_pct)


def value_distribution(df: DataFrame, column: str, by_count: bool = False) -> DataFrame:
    """Counts of each value, ordered by value or by falling count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column) if by_count else counts.orderBy(column)


def date_coverage(d: DataFrame, start: str, end: str, date: str = "acq_date") -> DataFrame:
    covered = (F.min(date) <= F.lit(start).cast("date")) & (F.max(date) >= F.lit(end).cast("date"))
    return d.agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), covered.alias("passed"))


def spatial_coverage(d: DataFrame, box: Box, need_pct: float = 80.0) -> DataFrame:
    pct = F.avg(strictly_within(F.col("latitude"), F.col("longitude"), box).cast("double")) * 100
    return d.agg(pct.alias("inside_pct")).withColumn("passed", F.col("inside_pct") >= need_pct)


def validation(d: DataFrame, box: Box, start: str, end: str, need_pct: float = 80.0) -> DataFrame:
    """(check, passed) of the schema, date, place and quality checks, and of all of them together, in
    one pass over the table. A check whose columns are absent has failed."""

    def has(*columns: str) -> bool:
        return all(c in d.columns for c in columns)

    failed = F.max(F.lit(False))
    dates, place = failed, failed
    if has("acq_date"):
        dates = (F.min("acq_date") <= F.lit(start).cast("date")) & (F.max("acq_date") >= F.lit(end).cast("date"))
    if has("latitude", "longitude"):
        place = F.avg(strictly_within(F.col("latitude"), F.col("longitude"), box).cast("double")) * 100 >= need_pct
    checks = d.agg(F.lit(has(*REQUIRED_DETECTION_COLUMNS)).alias("schema"), dates.alias("dates"), place.alias("place"), F.lit(True).alias("quality"))
    every = checks.withColumn("all", F.col("schema") & F.col("dates") & F.col("place") & F.col("quality"))
    return every.unpivot([], every.columns, "check", "passed")


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_DETECTION_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def share(df: DataFrame, by: str | Column, name: str) -> DataFrame:
    """Counts and percent of all, per group."""
    key = (F.col(by) if isinstance(by, str) else by).alias(name)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def region_breakdown(points: DataFrame, split_lat: float = 30.0, west: float = 67.0, middle: tuple[float, float] = (78.3, 80.8), east: float = 85.1) -> DataFrame:
    """Counts and ranges of points by bands of latitude and longitude."""
    north_south = F.when(F.col("lat") > split_lat, "northern").otherwise("southern")
    band = (
        F.when(F.col("lon") < west, "west")
        .when((F.col("lon") > middle[0]) & (F.col("lon") < middle[1]), "between tiles")
        .when(F.col("lon") > east, "east")
        .otherwise("elsewhere")
    )
    return points.groupBy(north_south.alias("half"), band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def completeness(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n_valid, valid_pct, min, max) of each feature."""
    long = df.select(*features).unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(
        F.count("value").alias("n_valid"),
        (F.count("value") * 100.0 / F.count(F.lit(1))).alias("valid_pct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def dataset_summary(points: DataFrame) -> DataFrame:
    """Rows, class shares, years and bounds in one row."""
    years = F.array_join(F.array_sort(F.collect_set(F.year("date").cast("string"))), ",")
    fires = F.sum(F.col("is_fire").cast("int"))
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        fires.alias("n_fire"),
        (fires * 100.0 / F.count(F.lit(1))).alias("fire_pct"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        years.alias("years"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def selection_rates(features: DataFrame) -> DataFrame:
    """(category, total, selected, dropped, selected_pct) out of (feature, selected)."""
    chosen = F.sum(F.col("selected").cast("int"))
    return features.groupBy(feature_category(F.col("feature")).alias("category")).agg(
        F.count(F.lit(1)).alias("total"),
        chosen.alias("selected"),
        (F.count(F.lit(1)) - chosen).alias("dropped"),
        (chosen * 100.0 / F.count(F.lit(1))).alias("selected_pct"),
    )
