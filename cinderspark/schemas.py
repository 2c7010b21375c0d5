"""Declared schemas of the tables that come in as text or files."""

from pyspark.sql import types as T

# Columns of a detection feed, in file order.
DETECTIONS = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("brightness", T.DoubleType()),
        T.StructField("scan", T.DoubleType()),
        T.StructField("track", T.DoubleType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("acq_time", T.IntegerType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("version", T.StringType()),
        T.StructField("bright_t31", T.DoubleType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("daynight", T.StringType()),
        T.StructField("type", T.IntegerType()),
    ]
)

# Columns a detection feed must have.
REQUIRED_DETECTION_COLUMNS = [
    "latitude",
    "longitude",
    "acq_date",
    "acq_time",
    "satellite",
    "confidence",
    "brightness",
    "scan",
    "track",
]

REQUESTS = T.StructType(
    [
        T.StructField("pid", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("date", T.StringType()),
    ]
)

RAW_CELLS = T.StructType(
    [
        T.StructField("product", T.StringType()),
        T.StructField("tile", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("day", T.DateType()),
        T.StructField("band", T.StringType()),
        T.StructField("raw", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
    ]
)
