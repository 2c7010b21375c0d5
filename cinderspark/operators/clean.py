"""Cleaning of feature matrices."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderspark.operators.quantiles import exact_quantiles
from cinderspark.params import NOT_FEATURES


def feature_columns(df: DataFrame, excluded: list[str] = NOT_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in excluded]


def complete_columns(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Features in fixed order, absent ones as NULL."""
    return df.select(
        *keep, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in features]
    )


def resolve_target(df: DataFrame, name: str = "target") -> DataFrame:
    """0/1 label from ``target``, else from ``is_fire``."""
    for source in ("target", "is_fire"):
        if source in df.columns:
            return df.withColumn(name, F.col(source).cast("boolean").cast("int"))
    raise ValueError("no target column: expected 'target' or 'is_fire'")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def fill(df: DataFrame, fillers: dict[str, float | None]) -> DataFrame:
    """Replace NULL and NaN by a value per column; columns without a value stay as they are."""
    return df.withColumns(
        {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(v)) for c, v in fillers.items() if v is not None}
    )


def impute_medians(df: DataFrame, columns: list[str], basis: DataFrame | None = None) -> DataFrame:
    """Fill gaps with medians of ``basis`` (all rows of ``df`` unless the training rows are given)."""
    return fill(df, medians(df if basis is None else basis, columns))


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return fill(df, {c: 0.0 for c in columns})


def infinite_to_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(c) == F.lit(float("inf")), 0.0).otherwise(F.col(c)) for c in columns})


def clean_for_training(df: DataFrame, columns: list[str], basis: DataFrame | None = None) -> DataFrame:
    """Median impute, then zero fill, then infinities to zero."""
    return infinite_to_zero(zero_fill(impute_medians(df, columns, basis), columns), columns)


def clean_for_scoring(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zeros only; medians of the training rows are not at hand when scoring."""
    return infinite_to_zero(zero_fill(df, columns), columns)


def clean_curve(value: Column) -> Column:
    """NaN and NULL to 0, +Inf to 1, -Inf to 0."""
    return (
        F.when(value.isNull() | F.isnan(value), 0.0)
        .when(value == F.lit(float("inf")), 1.0)
        .when(value == F.lit(float("-inf")), 0.0)
        .otherwise(value)
    )
