"""The 24-column feature matrix."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.operators.lookback import RAIN, window_per_key
from cinderspark.operators.skew import lookup
from cinderspark.operators.windowstats import rain_statistics, temperature_statistics, vegetation_statistics
from cinderspark.params import FEATURES, TERRAIN_FEATURES, Lookback


@dataclass(frozen=True)
class Observations:
    """Cell tables and the point columns that address them.

    rain: (*rain_key, day, mm); temperature: (*temperature_key, day, kelvin);
    vegetation: (*vegetation_key, day, ndvi, evi, ndwi); terrain: (*terrain_key, elevation, slope, aspect).
    """

    rain: DataFrame
    temperature: DataFrame
    vegetation: DataFrame
    terrain: DataFrame
    rain_key: tuple[str, ...] = ("cell",)
    temperature_key: tuple[str, ...] = ("cell",)
    vegetation_key: tuple[str, ...] = ("cell",)
    terrain_key: tuple[str, ...] = ("terrain_row", "terrain_col")

    def written(self, folder: str) -> "Observations":
        """The same tables, worked out once and read back, for many small uses such as micro-batches."""

        def keep(name: str) -> DataFrame:
            df: DataFrame = getattr(self, name)
            df.write.parquet(f"{folder}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

        return replace(self, **{name: keep(name) for name in ("rain", "temperature", "vegetation", "terrain")})


def label_points(positives: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Union of fire and no-fire points with ``is_fire``."""
    fires = positives.withColumn("is_fire", F.lit(True))
    if negatives is None:
        return fires
    return fires.unionByName(negatives.withColumn("is_fire", F.lit(False)), allowMissingColumns=True)


def dynamic_features(points: DataFrame, obs: Observations, p: Lookback = RAIN, date: str = "date") -> DataFrame:
    """Windows and the 21 time-dependent features of each distinct (cells, date)."""
    key = list(dict.fromkeys([*obs.rain_key, *obs.temperature_key, *obs.vegetation_key]))
    sites = points.where(F.col(date).isNotNull()).select(*key, date).distinct()
    windows = window_per_key(sites, obs.rain, list(obs.rain_key), date, "day", "mm", p)
    if set(key) == set(obs.rain_key):
        frame = windows
    else:
        frame = sites.join(windows, [*obs.rain_key, date])
    frame = rain_statistics(frame, obs.rain, list(obs.rain_key), max_days=p.max_days)
    frame = temperature_statistics(frame, obs.temperature, list(obs.temperature_key), max_days=p.max_days)
    return vegetation_statistics(frame, obs.vegetation, list(obs.vegetation_key), max_days=p.max_days)


def extract_features(points: DataFrame, obs: Observations, p: Lookback = RAIN, date: str = "date") -> DataFrame:
    """Points with a date, plus window columns and the 24 features in fixed order."""
    dated = points.where(F.col(date).isNotNull())
    key = list(dict.fromkeys([*obs.rain_key, *obs.temperature_key, *obs.vegetation_key]))
    dynamic = lookup(dated, dynamic_features(dated, obs, p, date), [*key, date])
    full = lookup(dynamic, obs.terrain.select(*obs.terrain_key, *TERRAIN_FEATURES), list(obs.terrain_key), counted=dated)
    return full.select(*points.columns, "dtw_start", "dtw_end", "dtw_length", *FEATURES)


def null_features(features: list[str] = FEATURES):
    """How many of the features of a row are NULL."""
    first, *rest = [F.col(c).isNull().cast("int") for c in features]
    return sum(rest, first)


def feature_matrix(
    points: DataFrame, obs: Observations, p: Lookback = RAIN, date: str = "date", max_null_share: float | None = 0.5
) -> DataFrame:
    """Labelled points -> features and ``target``; rows with too many NULL features are dropped, or
    none are if ``max_null_share`` is None."""
    matrix = extract_features(points, obs, p, date).withColumn("target", F.col("is_fire").cast("int"))
    if max_null_share is None:
        return matrix
    return matrix.where(null_features() <= len(FEATURES) * max_null_share)
