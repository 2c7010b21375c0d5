"""Scans of detections, cell tables, archives and elevation tiles."""

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderspark.functions.grid import within
from cinderspark.params import REGION, Box
from cinderspark.schemas import DETECTIONS, RAW_CELLS

# The number that marks a void.
HGT_NODATA = -32768


def read_detections_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(DETECTIONS).option("header", True).csv(path)


def detection_points(d: DataFrame, box: Box = REGION) -> DataFrame:
    """Distinct (lat, lon, date) of the detections in a box."""
    inside = d.where(within(F.col("latitude"), F.col("longitude"), box))
    return inside.select(
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.to_date("acq_date").alias("date")
    ).dropDuplicates()


def detection_points_all(d: DataFrame) -> DataFrame:
    """Every row and column, renamed."""
    return d.withColumnsRenamed({"latitude": "lat", "longitude": "lon", "acq_date": "date"}).withColumn("date", F.to_date("date"))


def of_year(points: DataFrame, year: int, date: str = "date") -> DataFrame:
    """Rows of one year, as a range on the date so that it reaches the scan."""
    first, after = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date")
    return points.where((F.col(date) >= first) & (F.col(date) < after))


def of_years(feed: DataFrame, first: int, last: int, date: str = "acq_date") -> DataFrame:
    """Rows from 1 January of the first to 31 December of the last year."""
    return feed.where(F.col(date).between(F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last}-12-31").cast("date")))


def consolidate(yearly: list[DataFrame], box: Box) -> DataFrame:
    """Union of yearly feeds, cut to a box, ordered by day. The caller leaves out years it lacks."""
    first, *rest = yearly
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first.where(within(F.col("latitude"), F.col("longitude"), box)).orderBy("acq_date")


def write_detections(d: DataFrame, path: str) -> None:
    """CSV in the declared column order; an empty table still writes its header."""
    present = d.columns
    columns = [
        F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in DETECTIONS.fields
    ]
    # One file per range of days, so that the order survives without passing one task.
    d.select(*columns).write.mode("overwrite").option("header", True).csv(path)


# Rows handed over at once by the archive reader.
ARCHIVE_LINES = 50_000


def read_detection_archives(spark: SparkSession, path: str, country: str = "India") -> DataFrame:
    """Detections of one country out of yearly zip archives, whose member names hold year and country.

    Each archive is one task (a zip cannot be split); its member is read in slices, never whole.
    """
    columns = [f.name for f in DETECTIONS.fields]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not name.endswith(f"_{country}.csv"):
                            continue
                        with archive.open(name) as handle:
                            for part in pd.read_csv(handle, chunksize=ARCHIVE_LINES, dtype=str):
                                yield part.reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)

    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    raw = files.mapInPandas(members, text)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in DETECTIONS.fields])


def read_cells(
    spark: SparkSession, path: str, product: str, first_day: str | None = None, last_day: str | None = None, tiles: list[str] | None = None, bands: list[str] | None = None
) -> DataFrame:
    """Cells of a product from a table partitioned by product and year; a day range also prunes years."""
    cells = spark.read.schema(RAW_CELLS).parquet(path).where(F.col("product") == product)
    if first_day is not None:
        cells = cells.where((F.col("day") >= F.lit(first_day).cast("date")) & (F.col("year") >= int(first_day[:4])))
    if last_day is not None:
        cells = cells.where((F.col("day") <= F.lit(last_day).cast("date")) & (F.col("year") <= int(last_day[:4])))
    if tiles is not None:
        cells = cells.where(F.col("tile").isin(tiles))
    if bands is not None:
        cells = cells.where(F.col("band").isin(bands))
    return cells


def write_cells(cells: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by product and year; rows of a tile and day lie together, spread over the tasks."""
    placed = cells.withColumn("year", F.year("day"))
    placed.repartition("product", "year", "tile", "day").sortWithinPartitions("product", "year", "tile", "day", "row", "col").write.mode(
        mode
    ).partitionBy("product", "year").parquet(path)


# Raster rows handed over at once by the elevation reader.
HGT_ROWS = 64


def read_elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ``.hgt`` files, plain or zipped: (file, south, west, row, col, elevation).

    A plain file wins over a zipped one of the same name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract(F.upper("path"), r"([NS]\d{2}[EW]\d{3})[^/]*\.HGT(\.ZIP)?$", 1)
    zipped = F.lower("path").endswith(".zip")
    listed = files.select("path", name.alias("file"), zipped.cast("int").alias("zipped")).where("file <> ''")
    chosen = listed.groupBy("file").agg(F.min_by("path", F.struct("zipped", "path")).alias("path"))
    return elevation_cells(chosen.join(files.select("path", "content"), "path").select("file", "content"))


def elevation_cells(contents: DataFrame) -> DataFrame:
    """Cells of (file, content) rows; the file name gives the south-west corner.

    Values are big-endian 16-bit numbers, north row first. A file is one row of one task, and its raster
    rows are handed over in slices.
    """

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                data = content
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        data = archive.read(next(n for n in archive.namelist() if n.lower().endswith(".hgt")))
                values = np.frombuffer(data, dtype=">i2")
                side = int(np.sqrt(values.size))
                raster = values.reshape(side, side)
                north, south, east, west = re.match(r"([NS])(\d+)([EW])(\d+)", file).groups()
                south = int(south) * (1 if north == "N" else -1)
                west = int(west) * (1 if east == "E" else -1)
                for start in range(0, side, HGT_ROWS):
                    part = raster[start : start + HGT_ROWS]
                    rows, cols = np.indices(part.shape, dtype=np.int32)
                    yield pd.DataFrame(
                        {
                            "file": file,
                            "south": np.int32(south),
                            "west": np.int32(west),
                            "row": (rows + start).ravel().astype(np.int32),
                            "col": cols.ravel(),
                            "elevation": part.ravel().astype(np.float64),
                        }
                    )

    return contents.mapInPandas(cells, "file string, south int, west int, row int, col int, elevation double")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
