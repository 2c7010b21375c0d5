"""Sinks: feature matrices, sidecar records, stage tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.operators.evaluation import classification_metrics
from cinderspark.params import FEATURES


def matrix_metadata(matrix: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row: counts, feature names, class counts, time."""
    return matrix.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.struct(
            F.count(F.when(F.col("target") == 0, 1)).alias("0"), F.count(F.when(F.col("target") == 1, 1)).alias("1")
        ).alias("target_distribution"),
    ).select(
        "num_samples",
        F.lit(len(features)).alias("num_features"),
        F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
        "target_distribution",
        F.current_timestamp().alias("created_at"),
    )


def save_matrix(matrix: DataFrame, path: str, features: list[str] = FEATURES, mode: str = "overwrite") -> DataFrame:
    """Write the matrix as parquet and its metadata as JSON beside it; returns the metadata."""
    matrix.write.mode(mode).parquet(path)
    stored = matrix.sparkSession.read.parquet(path)
    metadata = matrix_metadata(stored, features)
    metadata.write.mode(mode).json(f"{path}_metadata")
    return metadata


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Table of a finished stage; it is built when it is not there yet, or when forced.

    A write only counts as finished with its success marker, so a stage that died half-way is redone.
    """
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = not force and marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
    if not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def result_summary(predictions: DataFrame, model_type: str, features: list[str]) -> DataFrame:
    """One nested row: model, features, metrics, confusion counts, time."""
    metrics = classification_metrics(predictions)
    t, h = F.col("y"), F.col("yhat")
    counts = predictions.agg(
        F.struct(
            F.count(F.when((t == 1) & (h == 1), 1)).alias("tp"),
            F.count(F.when((t == 0) & (h == 1), 1)).alias("fp"),
            F.count(F.when((t == 1) & (h == 0), 1)).alias("fn"),
            F.count(F.when((t == 0) & (h == 0), 1)).alias("tn"),
        ).alias("confusion")
    )
    # Two one-row tables.
    return metrics.select(F.struct("*").alias("metrics")).join(F.broadcast(counts)).select(
        F.lit(model_type).alias("model_type"),
        F.array(*[F.lit(c) for c in features]).alias("features"),
        "metrics",
        "confusion",
        F.current_timestamp().alias("created_at"),
    )
