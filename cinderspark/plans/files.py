"""Scans, catalogs and sinks over the test tables. File forms are made out of the tables first."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.operators.spatial import sample_cells
from cinderspark.params import CONFIGURED_REGION, FEATURES, REGION
from cinderspark.plans import fixtures as fx
from cinderspark.plans.core import rounded
from cinderspark.plans.registry import query
from cinderspark.session import cut_lineage, shared_folder
from cinderspark.sources import granules, sinks, tables
from cinderspark.functions.values import reflectance

POINT_SQL = "latitude AS lat, longitude AS lon, acq_date AS date"
IN_REGION = "latitude BETWEEN 287e-1 AND 315e-1 AND longitude BETWEEN 775e-1 AND 81"


def scratch(spark, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("s1_detection_scan", fx.ctes("detections") + f"SELECT DISTINCT {POINT_SQL} FROM detections WHERE {IN_REGION}")
def s1(spark, folder):
    return tables.detection_points(fx.detections(spark, folder), REGION)


@query("s1_detection_scan_csv", fx.ctes("detections") + f"SELECT DISTINCT {POINT_SQL} FROM detections WHERE {IN_REGION}")
def s1_csv(spark, folder):
    """The same through a CSV feed that is written first."""
    path = scratch(spark, "feed")
    tables.write_detections(fx.detections(spark, folder), path)
    return tables.detection_points(tables.read_detections_csv(spark, path), REGION)


@query(
    "s2_detection_scan_all",
    fx.ctes("detections") + f"SELECT {POINT_SQL}, brightness, scan, track, acq_time, satellite, instrument, confidence, version, bright_t31, frp, daynight, type FROM detections",
)
def s2(spark, folder):
    return tables.detection_points_all(fx.detections(spark, folder))


@query("s3_single_year", fx.ctes("detections") + f"SELECT {POINT_SQL}, confidence FROM detections WHERE year(acq_date) = 2000")
def s3(spark, folder):
    points = tables.detection_points_all(fx.detections(spark, folder))
    return tables.of_year(points, 2000).select("lat", "lon", "date", "confidence")


@query(
    "s4_consolidate_years",
    fx.ctes("detections")
    + """SELECT latitude, longitude, acq_date, satellite, confidence FROM detections WHERE year(acq_date) BETWEEN 1996 AND 2000
    AND latitude BETWEEN 28709556e-6 AND 31459016e-6 AND longitude BETWEEN 77575402e-6 AND 81044789e-6 ORDER BY acq_date""",
)
def s4(spark, folder):
    feed = fx.detections(spark, folder)
    yearly = [tables.of_years(feed, year, year) for year in range(1996, 2001)]
    path = scratch(spark, "consolidated")
    tables.write_detections(tables.consolidate(yearly, CONFIGURED_REGION), path)
    return tables.read_detections_csv(spark, path).select("latitude", "longitude", "acq_date", "satellite", "confidence")


@query(
    "s5_date_range_slice",
    fx.ctes("detections") + "SELECT latitude, longitude, acq_date FROM detections WHERE acq_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
)
def s5(spark, folder):
    return tables.of_years(fx.detections(spark, folder), 1997, 1999).select("latitude", "longitude", "acq_date")


FILES_SQL = """, band_files AS (SELECT 'MYD09GA.' || CASE WHEN cell % 4 = 0 THEN 'A' ELSE 'AA' END || year(day) || lpad(CAST(dayofyear(day) AS VARCHAR), 3, '0') || '.h24v' || lpad(CAST(cell % 7 AS VARCHAR), 2, '0') || '.061.' ||
    CASE band WHEN 'red' THEN 'B01' WHEN 'nir' THEN 'B02' WHEN 'blue' THEN 'B03' WHEN 'swir1' THEN 'B06' ELSE 'B07' END || '.tif' AS name, raw * 1000 AS size FROM daily_bands),
  files AS (SELECT name, CAST(sum(size) AS BIGINT) AS size FROM (
    SELECT * FROM band_files UNION ALL
    SELECT 'chirps-v2.0.' || year(day) || '.' || lpad(CAST(dayofyear(day) AS VARCHAR), 3, '0') || '.tif', CAST(mm * 1000 AS BIGINT) FROM rain UNION ALL
    SELECT 'MOD11A1.AA' || year(day) || lpad(CAST(dayofyear(day) AS VARCHAR), 3, '0') || '.h24v' || lpad(CAST(cell % 7 AS VARCHAR), 2, '0') || '.061.LST_Day_1km.tif', raw FROM temperature_raw UNION ALL
    SELECT 'README.' || cell || '.txt', 1 FROM rain) GROUP BY 1),
  granules AS (SELECT name, CASE split_part(name, '.', 1) WHEN 'chirps-v2' THEN 'rain' WHEN 'MYD09GA' THEN 'reflectance' ELSE 'temperature' END AS dataset,
    CASE WHEN name LIKE 'chirps%' THEN 'chirps-v2.0' ELSE split_part(name, '.', 1) END AS product,
    CAST(CASE WHEN name LIKE 'chirps%' THEN split_part(name, '.', 3) ELSE left(ltrim(split_part(name, '.', 2), 'A'), 4) END AS INTEGER) AS year,
    CAST(CASE WHEN name LIKE 'chirps%' THEN split_part(name, '.', 4) ELSE right(split_part(name, '.', 2), 3) END AS INTEGER) AS doy,
    CASE WHEN name NOT LIKE 'chirps%' THEN split_part(name, '.', 3) END AS tile, CASE WHEN name NOT LIKE 'chirps%' THEN split_part(name, '.', 4) END AS collection,
    CASE WHEN name NOT LIKE 'chirps%' THEN split_part(name, '.', 5) END AS band, size / 1048576e0 AS size_mb FROM files WHERE name NOT LIKE 'README%')"""
FILES = fx.ctes("daily_bands", "rain", "temperature_raw") + FILES_SQL


def file_listing(spark, folder):
    """Names and sizes of the files the cells would come from, in old and new form, and others."""
    stamp = F.concat(F.year("day").cast("string"), F.lpad(F.dayofyear("day").cast("string"), 3, "0"))
    tile = F.concat(F.lit("h24v"), F.lpad((F.col("cell") % 7).cast("string"), 2, "0"))
    code = F.lit("B07")
    for band, text in {"red": "B01", "nir": "B02", "blue": "B03", "swir1": "B06"}.items():
        code = F.when(F.col("band") == band, text).otherwise(code)
    bands = fx.daily_bands(spark, folder)
    rain, heat = fx.rain(spark, folder), fx.temperature_raw(spark, folder)
    mark = F.when(F.col("cell") % 4 == 0, "A").otherwise("AA")
    parts = [
        bands.select(F.concat(F.lit("MYD09GA."), mark, stamp, F.lit("."), tile, F.lit(".061."), code, F.lit(".tif")).alias("name"), (F.col("raw") * 1000).cast("bigint").alias("size")),
        rain.select(F.concat(F.lit("chirps-v2.0."), F.year("day").cast("string"), F.lit("."), F.lpad(F.dayofyear("day").cast("string"), 3, "0"), F.lit(".tif")).alias("name"), (F.col("mm") * 1000).cast("bigint").alias("size")),
        heat.select(F.concat(F.lit("MOD11A1.AA"), stamp, F.lit("."), tile, F.lit(".061.LST_Day_1km.tif")).alias("name"), F.col("raw").cast("bigint").alias("size")),
        rain.select(F.concat(F.lit("README."), F.col("cell").cast("string"), F.lit(".txt")).alias("name"), F.lit(1).cast("bigint").alias("size")),
    ]
    listed = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("name").agg(F.sum("size").alias("size"))
    # Written once: conditions on names would otherwise move below the grouping and be worked out for every row of the tables.
    return cut_lineage(listed)


GRANULE_SQL = "SELECT name, dataset, product, year, doy, make_date(year, 1, 1) + (doy - 1) AS day, tile, collection, band, round(size_mb, 6) AS size_mb FROM granules"


@query("s6_granule_catalog", FILES + GRANULE_SQL)
def s6(spark, folder):
    return rounded(granules.catalog(file_listing(spark, folder)))


@query("s6_granule_totals", FILES + "SELECT dataset, year, count(*) AS n_files, round(sum(size_mb), 6) AS size_mb FROM granules GROUP BY 1, 2")
def s6_totals(spark, folder):
    return rounded(granules.catalog_totals(granules.catalog(file_listing(spark, folder))))


@query(
    "s7_granules_of_tiles",
    FILES + "SELECT name, tile FROM granules WHERE tile IN (SELECT 'h24v' || lpad(CAST(cell % 7 AS VARCHAR), 2, '0') FROM rain WHERE cell < 3)",
)
def s7(spark, folder):
    tile = F.concat(F.lit("h24v"), F.lpad((F.col("cell") % 7).cast("string"), 2, "0")).alias("tile")
    wanted = fx.rain(spark, folder).where("cell < 3").select(tile)
    return granules.of_tiles(granules.catalog(file_listing(spark, folder)), wanted).select("name", "tile")


@query(
    "s8_granule_renames",
    FILES
    + """, renamed AS (SELECT name, replace(name, '.A', '.AA') AS new_name FROM files WHERE regexp_matches(name, '\\.A[0-9]{7}\\.') AND name NOT LIKE '%.AA%')
    SELECT name, new_name FROM renamed ANTI JOIN (SELECT DISTINCT name AS new_name FROM files) USING (new_name)""",
)
def s8(spark, folder):
    return granules.normalise_names(file_listing(spark, folder))


@query(
    "s8_granule_name_audit",
    FILES
    + "SELECT count(*) FILTER (regexp_matches(name, '\\.A[0-9]{7}\\.') AND name NOT LIKE '%.AA%') AS n_old, count(*) FILTER (name LIKE '%.AA%') AS n_new FROM files",
)
def s8_audit(spark, folder):
    return granules.name_audit(file_listing(spark, folder))


@query(
    "k3_season_progress",
    FILES
    + """SELECT year, found, 3780 AS expected, CAST(floor(found * 100 / 3780) AS BIGINT) AS percent, june >= 10 AS complete FROM (
    SELECT year, count(*) FILTER (band = 'B01') AS found, count(*) FILTER (band = 'B01' AND doy BETWEEN 150 AND 189) AS june FROM granules WHERE product = 'MYD09GA' GROUP BY 1)""",
)
def k3(spark, folder):
    return granules.season_progress(granules.catalog(file_listing(spark, folder)))


@query(
    "k3_missing_days",
    FILES
    + """SELECT year, CAST(d AS DATE) AS day FROM (SELECT year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 6, 30), INTERVAL 1 DAY)) AS d
    FROM (SELECT DISTINCT year FROM granules WHERE dataset = 'rain')) WHERE CAST(d AS DATE) NOT IN (SELECT make_date(year, 1, 1) + (doy - 1) FROM granules WHERE dataset = 'rain')""",
)
def k3_days(spark, folder):
    return granules.missing_days(granules.catalog(file_listing(spark, folder)), "rain", 1, 6)


@query(
    "k4_source_presence",
    FILES
    + """SELECT dataset, count(name) AS n_files, count(name) > 0 AS present FROM (VALUES ('rain'), ('temperature'), ('reflectance'), ('terrain')) v(dataset)
    LEFT JOIN granules USING (dataset) GROUP BY 1""",
)
def k4(spark, folder):
    found = granules.catalog(file_listing(spark, folder))
    return granules.presence(found, ["rain", "temperature", "reflectance", "terrain"])


@query(
    "k4_point_has_value",
    fx.ctes("anchors", "daily_bands")
    + """SELECT pid, b.raw IS NOT NULL AND b.raw <> 7 AS has_value FROM anchors a LEFT JOIN (SELECT * FROM daily_bands WHERE band = 'red') b ON a.cell = b.cell AND a.date = b.day""",
)
def k4_point(spark, folder):
    red = fx.daily_bands(spark, folder).where("band = 'red'").withColumnRenamed("day", "date")
    found = sample_cells(fx.anchors(spark, folder), red, ["cell", "date"], ["raw"])
    return found.select("pid", reflectance(F.col("raw"), 7).isNotNull().alias("has_value"))


@query(
    "s9_cell_table_scan",
    fx.ctes("daily_bands")
    + """SELECT cell AS row, day, band, CAST(raw AS DOUBLE) AS raw FROM daily_bands WHERE day BETWEEN DATE '1998-03-01' AND DATE '1999-05-31' AND band IN ('red', 'nir') AND cell % 7 IN (5, 6)""",
)
def s9(spark, folder):
    cells = fx.daily_bands(spark, folder).select(
        F.lit("reflectance").alias("product"),
        F.concat(F.lit("h24v"), F.lpad((F.col("cell") % 7).cast("string"), 2, "0")).alias("tile"),
        F.col("cell").alias("row"), F.lit(0).alias("col"), "day", "band", F.col("raw").cast("double").alias("raw"),
    )
    path = scratch(spark, "cells")
    tables.write_cells(cells, path)
    found = tables.read_cells(spark, path, "reflectance", "1998-03-01", "1999-05-31", ["h24v05", "h24v06"], ["red", "nir"])
    return found.select("row", "day", "band", "raw")


def small_matrix(spark, folder):
    """Feature rows with terrain columns only, for the sinks."""
    from cinderspark.operators.clean import complete_columns, resolve_target
    from cinderspark.plans.places import j1_static

    found = j1_static(spark, folder).join(fx.anchors(spark, folder).select("pid", "lat", "lon", "date", "is_fire"), "pid")
    return resolve_target(complete_columns(found, FEATURES, ["pid", "lat", "lon", "date", "is_fire"]))


@query(
    "s13_matrix_sink",
    fx.ctes("anchors")
    + "SELECT count(*) AS num_samples, 24 AS num_features, 24 AS n_names, count(*) FILTER (NOT is_fire) AS n_negative, count(*) FILTER (is_fire) AS n_positive FROM anchors",
)
def s13(spark, folder):
    metadata = sinks.save_matrix(small_matrix(spark, folder), scratch(spark, "matrix"))
    return metadata.select(
        "num_samples", "num_features", F.size("feature_columns").alias("n_names"),
        F.col("target_distribution.0").alias("n_negative"), F.col("target_distribution.1").alias("n_positive"),
    )


@query(
    "s14_matrix_scan",
    fx.ctes("anchors", "elevation")
    + """, j AS (SELECT pid, is_fire, e.elevation FROM anchors a LEFT JOIN elevation e ON a.terrain_row = e.row AND a.terrain_col = e.col), m AS (SELECT median(elevation) AS m FROM j)
    SELECT pid, CAST(is_fire AS INTEGER) AS target, coalesce(elevation, m) AS elevation, 0e0 AS slope FROM j, m""",
)
def s14(spark, folder):
    from cinderspark.operators import clean

    path = scratch(spark, "matrix")
    small_matrix(spark, folder).write.parquet(path)
    stored = clean.resolve_target(tables.read_matrix(spark, path))
    features = [c for c in clean.feature_columns(stored) if c != "pid"]
    return clean.clean_for_training(stored, features).select("pid", "target", "elevation", "slope")


@query("s15_stage_output", fx.ctes("fires") + "SELECT cell, count(*) AS n FROM fires GROUP BY 1")
def s15(spark, folder):
    """Built once, then reused: the second builder must not run."""
    path = scratch(spark, "stage")
    sinks.stage(spark, path, lambda: fx.fires(spark, folder).groupBy("cell").agg(F.count("*").alias("n")))
    return sinks.stage(spark, path, lambda: fx.anchors(spark, folder).select("cell", F.col("pid").alias("n")))


# 16-bit code of a cell without a part.
NO_PART = 32769


@query(
    "s10_elevation_tiles",
    """SELECT printf('N%02dE%03d', CAST(p_partkey // 100 % 90 AS INTEGER), CAST(p_partkey // 100 AS INTEGER)) AS file, CAST(p_partkey // 100 % 90 AS INTEGER) AS south,
    CAST(p_partkey // 100 AS INTEGER) AS west, CAST(p_partkey % 100 // 10 AS INTEGER) AS row, CAST(p_partkey % 10 AS INTEGER) AS col,
    CASE WHEN p_partkey % 17 = 0 THEN -32768e0 ELSE floor(p_retailprice) END AS elevation FROM part""",
)
def s10(spark, folder):
    """Tiles of ten by ten parts are encoded to file bytes first, and then read. Cells without a part get a code of their
    own; parts that share a key go to further files of their tile."""
    value = F.when(F.col("p_partkey") % 17 == 0, F.lit(32768)).otherwise(F.floor("p_retailprice").cast("int"))
    tile = F.floor(F.col("p_partkey") / F.lit(100.0)).cast("int").alias("tile")
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey") % 100, value)))
    copy = F.row_number().over(Window.partitionBy("p_partkey").orderBy("p_retailprice"))
    listed = fx.table(spark, folder, "part").withColumn("copy", copy).groupBy(tile, "copy").agg(cells.alias("cells"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))
    code = F.transform(places, lambda at: F.lpad(F.hex(F.coalesce(F.try_element_at("cells", at), F.lit(NO_PART))), 4, "0"))
    content = F.unhex(F.array_join(code, ""))
    name = F.format_string("N%02dE%03d", F.col("tile") % 90, F.col("tile"))
    read = tables.elevation_cells(listed.select(name.alias("file"), content.alias("content")))
    return read.where(F.col("elevation") != NO_PART - (1 << 16))
