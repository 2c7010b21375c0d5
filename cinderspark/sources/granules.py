"""Catalogs of daily files: names, dates, tiles, bands, sizes; nothing is opened."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.functions.calendar import date_from_day_of_year, season_days

# File-name patterns, and the data set each product belongs to.
RAIN_NAME = r"^chirps-v2\.0\.(\d{4})\.(\d{3})\.tif$"
TILE_NAME = r"^(MYD09GA|MOD11A1)\.A{1,2}(\d{4})(\d{3})\.(h\d{2}v\d{2})\.(\d{3})\.(.+)\.tif$"
DATASETS = {"MYD09GA": "reflectance", "MOD11A1": "temperature"}
RAIN_PRODUCT = "chirps-v2.0"

# Completeness rule of the seasonal files.
BANDS_PER_DAY = 7
TILES_PER_DAY = 3
SEASON_DAYS = 180
JUNE_DAYS = (150, 189)
JUNE_FILES = 10


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of every file under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def catalog(files: DataFrame) -> DataFrame:
    """(name, dataset, product, year, doy, day, tile, collection, band, size_mb) of known names."""
    name = F.col("name")
    rain = name.rlike(RAIN_NAME)
    part = lambda i: F.regexp_extract(name, TILE_NAME, i)
    product = F.when(rain, RAIN_PRODUCT).otherwise(part(1))
    dataset = F.when(rain, "rain")
    for code, label in DATASETS.items():
        dataset = dataset.when(part(1) == code, label)
    year = F.when(rain, F.regexp_extract(name, RAIN_NAME, 1)).otherwise(part(2)).cast("int")
    doy = F.when(rain, F.regexp_extract(name, RAIN_NAME, 2)).otherwise(part(3)).cast("int")
    text = lambda i: F.when(~rain, part(i))
    return (
        files.where(rain | name.rlike(TILE_NAME))
        .select(
            "name", dataset.alias("dataset"), product.alias("product"), year.alias("year"), doy.alias("doy"),
            text(4).alias("tile"), text(5).alias("collection"), text(6).alias("band"),
            (F.col("size") / F.lit(1048576.0)).alias("size_mb"),
        )
        .withColumn("day", date_from_day_of_year(F.col("year"), F.col("doy")))
    )


def catalog_totals(granules: DataFrame) -> DataFrame:
    return granules.groupBy("dataset", "year").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_mb").alias("size_mb"))


def of_tiles(granules: DataFrame, tiles: DataFrame) -> DataFrame:
    """Granules of the listed tiles."""
    return granules.join(tiles.select("tile").distinct(), "tile", "left_semi")


def is_old_name(name: Column) -> Column:
    return name.rlike(r"\.A\d{7}\.")


def is_new_name(name: Column) -> Column:
    return name.contains(".AA")


def normalise_names(files: DataFrame) -> DataFrame:
    """(name, new_name) of the files to rename: old form, and no file has the new name yet."""
    old = files.where(is_old_name(F.col("name")) & ~is_new_name(F.col("name")))
    renamed = old.select("name", F.replace("name", F.lit(".A"), F.lit(".AA")).alias("new_name"))
    return renamed.join(files.select(F.col("name").alias("new_name")).distinct(), "new_name", "left_anti").select("name", "new_name")


def name_audit(files: DataFrame) -> DataFrame:
    """How many names have the old and the new form."""
    name = F.col("name")
    return files.agg(
        F.count(F.when(is_old_name(name) & ~is_new_name(name), 1)).alias("n_old"),
        F.count(F.when(is_new_name(name), 1)).alias("n_new"),
    )


def season_progress(granules: DataFrame) -> DataFrame:
    """Per year: first-band files found, files expected, percent, and whether June has enough days."""
    first_band = F.col("band") == "B01"
    june = first_band & F.col("doy").between(*JUNE_DAYS)
    expected = SEASON_DAYS * BANDS_PER_DAY * TILES_PER_DAY
    return (
        granules.where(F.col("product") == "MYD09GA")
        .groupBy("year")
        .agg(F.count(F.when(first_band, 1)).alias("found"), F.count(F.when(june, 1)).alias("june_files"))
        .select(
            "year", "found", F.lit(expected).cast("bigint").alias("expected"),
            F.floor(F.col("found") * 100 / expected).alias("percent"), (F.col("june_files") >= JUNE_FILES).alias("complete"),
        )
    )


def missing_days(granules: DataFrame, dataset: str, first: int, last: int) -> DataFrame:
    """(year, day) of a season for which the data set has no file, for the years it has."""
    mine = granules.where(F.col("dataset") == dataset)
    days = mine.select("year").distinct().select("year", F.explode(season_days(F.col("year"), first, last)).alias("day"))
    return days.join(mine.select("day").distinct(), "day", "left_anti").select("year", "day")


def presence(granules: DataFrame, products: list[str]) -> DataFrame:
    """(dataset, n_files, present) of each listed data set."""
    wanted = granules.sparkSession.createDataFrame([(p,) for p in products], "dataset string")
    counts = granules.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"))
    return wanted.join(counts, "dataset", "left").select(
        "dataset", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.col("n_files").isNotNull().alias("present")
    )
