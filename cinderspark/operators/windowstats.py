"""Statistics of daily series over look-back windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderspark.operators.lookback import RAIN, attach_observations
from cinderspark.operators.skew import lookup


def array_statistics(sorted_values: Column, prefix: str, with_sum: bool = False) -> list[Column]:
    """min, median (middle value, or mean of the middle two), mean, max[, sum] of a rising array.

    An empty array gives NULLs.
    """
    n = F.size(sorted_values)
    total = F.aggregate(sorted_values, F.lit(0.0), lambda a, x: a + x)
    low = F.get(sorted_values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(sorted_values, F.floor(n / 2).cast("int"))
    out = [
        F.get(sorted_values, F.lit(0)).alias(f"{prefix}_min"),
        ((low + high) / 2).alias(f"{prefix}_median"),
        F.when(n > 0, total / n).alias(f"{prefix}_mean"),
        F.get(sorted_values, n - 1).alias(f"{prefix}_max"),
    ]
    return [*out, F.when(n > 0, total).alias(f"{prefix}_sum")] if with_sum else out


def rain_statistics(windows: DataFrame, rain: DataFrame, key: list[str], day: str = "day", value: str = "mm", max_days: int = RAIN.max_days) -> DataFrame:
    """Five rain statistics over every day of the window; a day without a row is a dry day.

    ``n_missing`` counts the days that had no row.
    """
    seen = attach_observations(windows, rain, key, day, [value], "_obs", max_days)
    return (
        seen.withColumn("_mm", F.array_compact(F.col("_obs")[value]))
        .withColumn("n_missing", F.size("_obs") - F.size("_mm"))
        .withColumn("_v", F.sort_array(F.concat("_mm", F.array_repeat(F.lit(0.0), F.col("n_missing")))))
        .select(*windows.columns, "n_missing", *array_statistics(F.col("_v"), "prec", with_sum=True))
    )


def temperature_statistics(windows: DataFrame, series: DataFrame, key: list[str], day: str = "day", value: str = "kelvin", max_days: int = RAIN.max_days) -> DataFrame:
    """Four temperature statistics over the days with a valid value; NULL if there is none."""
    seen = attach_observations(windows, series, key, day, [value], "_obs", max_days)
    return seen.withColumn("_v", F.sort_array(F.array_compact(F.col("_obs")[value]))).select(
        *windows.columns, *array_statistics(F.col("_v"), "lst")
    )


def vegetation_statistics(
    windows: DataFrame, indices: DataFrame, key: list[str], day: str = "day", step_days: int = 3, max_days: int = RAIN.max_days
) -> DataFrame:
    """Four statistics of three indices over every ``step_days``-th day from the window start."""
    names = ["ndvi", "evi", "ndwi"]
    seen = attach_observations(windows, indices, key, day, names, "_obs", max_days)
    out = seen.withColumn("_obs", F.filter("_obs", lambda _, i: i % step_days == 0))
    for name in names:
        out = out.withColumn(f"_{name}", F.sort_array(F.array_compact(F.col("_obs")[name])))
    statistics = [c for name in names for c in array_statistics(F.col(f"_{name}"), name)]
    return out.select(*windows.columns, *statistics)


def add_statistics(points: DataFrame, statistics: DataFrame, on: list[str]) -> DataFrame:
    """Batch form: statistics of the windows of the distinct ``on`` values, attached to every point."""
    added = [c for c in statistics.columns if c not in points.columns]
    return lookup(points, statistics.select(*on, *added), on)
