"""Risk bands, advice, request checks and feature categories."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.functions.grid import within
from cinderspark.params import REGION, Box

# Upper edges of the risk bands, and the band above the last edge.
RISK_EDGES = [(0.3, "Low"), (0.6, "Medium"), (0.8, "High")]
TOP_RISK = "Very High"

# Colour per band. The advice is our own.
ADVICE = [
    ("Low", "#00AA00", "No special steps; follow the usual rules for open flames"),
    ("Medium", "#FFA500", "Check the forecast each day and keep extinguishers within reach"),
    ("High", "#FF6B35", "Light no fires; clear dry growth near buildings; agree on a way out"),
    ("Very High", "#FF0000", "Tell the fire brigade, be ready to leave at once and follow official notices"),
]

# Last day with observations.
LAST_DATA_DAY = "2024-12-31"

# Category by name part (first match wins), static features, statistic by name part.
CATEGORY_PARTS = [
    ("prec", "Precipitation"),
    ("lst", "Temperature"),
    ("ndvi", "Vegetation (NDVI)"),
    ("evi", "Vegetation (EVI)"),
    ("ndwi", "Moisture (NDWI)"),
]
STATIC_FEATURES = ["elevation", "slope", "aspect"]
STATISTIC_PARTS = ["min", "median", "mean", "max", "sum"]


def risk_level(probability: Column) -> Column:
    (first_edge, first_band), *rest = RISK_EDGES
    chain = F.when(probability < first_edge, first_band)
    for edge, band in rest:
        chain = chain.when(probability < edge, band)
    return chain.when(probability.isNotNull(), TOP_RISK)


def confidence(probability: Column) -> Column:
    return F.abs(probability - F.lit(0.5)) * F.lit(2.0)


def advice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVICE, "risk_level string, colour string, advice string")


def request_error(
    lat: Column, lon: Column, date_text: Column, today: Column, box: Box = REGION, last_day: str = LAST_DATA_DAY
) -> Column:
    """Reason a request is refused, or NULL; the first failing check is the reason."""
    shaped = date_text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    day = F.when(shaped, F.try_to_date(date_text))
    return (
        F.when(lat.isNull() | ~lat.between(-90.0, 90.0), "latitude out of range")
        .when(lon.isNull() | ~lon.between(-180.0, 180.0), "longitude out of range")
        .when(day.isNull(), "invalid date")
        .when(day > today, "date in the future")
        .when(day > F.lit(last_day).cast("date"), "date after the last data day")
        .when(~within(lat, lon, box), "outside the region")
    )


def feature_category(name: Column) -> Column:
    (first_part, first_category), *rest = CATEGORY_PARTS
    chain = F.when(name.contains(first_part), first_category)
    for part, category in rest:
        chain = chain.when(name.contains(part), category)
    return chain.when(name.isin(STATIC_FEATURES), "Terrain").otherwise("Other")


def feature_statistic(name: Column) -> Column:
    first, *rest = STATISTIC_PARTS
    chain = F.when(name.contains(first), first.title())
    for part in rest:
        chain = chain.when(name.contains(part), part.title())
    return chain.otherwise("Static")
