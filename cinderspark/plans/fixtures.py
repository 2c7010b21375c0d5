"""Domain tables made out of the test tables, as DataFrames and as the same SQL.

Every table is a function ``(spark, folder) -> DataFrame``; ``SOURCES`` holds its SQL body under the
same name, and ``ctes`` puts bodies and those they need in front of a query.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Points in space and time: pid, lat, lon, date, cell, terrain_row, terrain_col, is_fire."""
    lat_m, lon_m = (F.col("o_orderkey") * 7919) % 2800, (F.col("o_orderkey") * 104729) % 3500
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pid"),
        (F.lit(28.7) + lat_m / F.lit(1e3)).alias("lat"),
        (F.lit(77.5) + lon_m / F.lit(1e3)).alias("lon"),
        F.to_date("o_orderdate").alias("date"),
        (F.floor(lat_m / F.lit(560.0)) * 5 + F.floor(lon_m / F.lit(700.0))).cast("int").alias("cell"),
        F.floor(lat_m / F.lit(70.0)).cast("int").alias("terrain_row"),
        F.floor(lon_m / F.lit(70.0)).cast("int").alias("terrain_col"),
        (F.col("o_orderstatus") == "F").alias("is_fire"),
    )


def fires(spark: SparkSession, folder: str) -> DataFrame:
    return anchors(spark, folder).where("is_fire")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """A detection feed in file form."""
    odd = F.col("o_orderkey") % 2
    lat_m, lon_m = (F.col("o_orderkey") * 7919) % 2800, (F.col("o_orderkey") * 104729) % 3500
    return table(spark, folder, "orders").select(
        (F.lit(28.7) + lat_m / F.lit(1e3)).alias("latitude"),
        (F.lit(77.5) + lon_m / F.lit(1e3)).alias("longitude"),
        (F.lit(300.0) + F.col("o_totalprice") / F.lit(1e4)).alias("brightness"),
        (F.lit(1.0) + odd).alias("scan"),
        F.lit(1.0).alias("track"),
        F.to_date("o_orderdate").alias("acq_date"),
        (F.col("o_orderkey") % 2400).cast("int").alias("acq_time"),
        F.when(odd == 0, "Terra").otherwise("Aqua").alias("satellite"),
        F.lit("MODIS").alias("instrument"),
        (F.col("o_orderkey") % 101).cast("int").alias("confidence"),
        F.lit("61.03").alias("version"),
        F.when(F.col("o_orderstatus") != "P", F.lit(280.0) + odd).alias("bright_t31"),
        (F.col("o_totalprice") / F.lit(1e3)).alias("frp"),
        F.when(odd == 0, "D").otherwise("N").alias("daynight"),
        F.lit(0).alias("type"),
    )


def rain(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy((F.col("l_suppkey") % 25).cast("int").alias("cell"), F.to_date("l_shipdate").alias("day"))
        .agg((F.sum("l_quantity") * 0.5).alias("mm"))
    )


def temperature_raw(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy((F.col("l_suppkey") % 25).cast("int").alias("cell"), F.to_date("l_shipdate").alias("day"))
        .agg(F.min(F.lit(9000) + (F.col("l_partkey") * F.col("l_linenumber") * 37) % 10000).cast("int").alias("raw"))
    )


def bands(spark: SparkSession, folder: str) -> DataFrame:
    """Raw reflectances of 30 days: cell, day, band, raw."""
    kind = F.col("event_type")
    band = (
        F.when(kind == "click", "red")
        .when(kind == "view", "nir")
        .when(kind == "purchase", "blue")
        .when(kind == "signup", "swir1")
        .when(kind == "error", "swir2")
    )
    return (
        table(spark, folder, "events")
        .groupBy((F.col("user_id") % 25).cast("int").alias("cell"), F.to_date("ts").alias("day"), band.alias("band"))
        .agg(F.round(F.avg("value") * 20).cast("int").alias("raw"))
    )


def daily_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Raw reflectances over the whole date range of the anchors; raw 7 stands for no data."""
    number = (F.col("l_linenumber") - 1) % 5 + 1
    band = (
        F.when(number == 1, "red")
        .when(number == 2, "nir")
        .when(number == 3, "blue")
        .when(number == 4, "swir1")
        .when(number == 5, "swir2")
    )
    return (
        table(spark, folder, "lineitem")
        .groupBy((F.col("l_suppkey") % 25).cast("int").alias("cell"), F.to_date("l_shipdate").alias("day"), band.alias("band"))
        .agg((F.sum(F.col("l_partkey") * 37) % 9973).cast("int").alias("raw"))
    )


def index_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points with a given window over the days of ``bands``."""
    end = F.to_date("ts")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("pid"),
        (F.col("user_id") % 25).cast("int").alias("cell"),
        F.date_sub(end, (F.col("event_id") % 15).cast("int")).alias("dtw_start"),
        end.alias("dtw_end"),
    )


def elevation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.floor(F.col("p_partkey") / F.lit(50.0)).cast("int").alias("row"),
        (F.col("p_partkey") % 50).cast("int").alias("col"),
        F.col("p_retailprice").alias("elevation"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score with many ties and a label: pid, score, y, date."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pid"),
        F.round(F.col("o_totalprice") / 1e3).alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.to_date("o_orderdate").alias("date"),
    )


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as probabilities: pid, p, y, yhat (p >= 0.5)."""
    p = F.col("score") / F.lit(500.0)
    return scores(spark, folder).select("pid", p.alias("p"), "y", (p >= 0.5).cast("int").alias("yhat"))


def labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Four continuous features and a label."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Score requests; some are broken on purpose. Good ones fall into the allowed years."""
    a = anchors(spark, folder)
    kind = F.col("pid") % 10
    text = (
        F.when(kind == 0, F.lit("2999-01-01")).when(kind == 2, F.lit("bad")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    )
    lat = F.when(kind == 1, F.col("lat") + 10).otherwise(F.col("lat"))
    return a.select("pid", lat.alias("lat"), "lon", text.alias("date"), "cell", "terrain_row", "terrain_col")


def gappy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows with NULLs and infinities: pid, f1 (some NULL), f2 (some infinite), f3 (all NULL)."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("pid"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("f1"),
        F.when(key % 11 == 0, F.lit(float("inf")))
        .when(key % 13 == 0, F.lit(float("-inf")))
        .when(key % 5 != 0, key * 0.25)
        .alias("f2"),
        F.lit(None).cast("double").alias("f3"),
        (F.col("o_orderstatus") == "F").alias("is_fire"),
        F.to_date("o_orderdate").alias("date"),
    )


ANCHOR_LAT = "2.87e1 + ((o_orderkey * 7919) % 2800) / 1e3"
ANCHOR_LON = "7.75e1 + ((o_orderkey * 104729) % 3500) / 1e3"
CELL_DAY = "CAST(l_suppkey % 25 AS INTEGER) AS cell, CAST(l_shipdate AS DATE) AS day"

SOURCES: dict[str, tuple[str, list[str]]] = {
    "anchors": (
        f"""SELECT o_orderkey AS pid, {ANCHOR_LAT} AS lat, {ANCHOR_LON} AS lon, CAST(o_orderdate AS DATE) AS date,
        CAST(floor(((o_orderkey * 7919) % 2800) / 5.6e2) * 5 + floor(((o_orderkey * 104729) % 3500) / 7e2) AS INTEGER) AS cell,
        CAST(floor(((o_orderkey * 7919) % 2800) / 7e1) AS INTEGER) AS terrain_row,
        CAST(floor(((o_orderkey * 104729) % 3500) / 7e1) AS INTEGER) AS terrain_col,
        o_orderstatus = 'F' AS is_fire FROM orders""",
        [],
    ),
    "fires": ("SELECT * FROM anchors WHERE is_fire", ["anchors"]),
    "detections": (
        f"""SELECT {ANCHOR_LAT} AS latitude, {ANCHOR_LON} AS longitude, 3e2 + o_totalprice / 1e4 AS brightness,
        1e0 + o_orderkey % 2 AS scan, 1e0 AS track, CAST(o_orderdate AS DATE) AS acq_date,
        CAST(o_orderkey % 2400 AS INTEGER) AS acq_time,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Terra' ELSE 'Aqua' END AS satellite, 'MODIS' AS instrument,
        CAST(o_orderkey % 101 AS INTEGER) AS confidence, '61.03' AS version,
        CASE WHEN o_orderstatus <> 'P' THEN 2.8e2 + o_orderkey % 2 END AS bright_t31, o_totalprice / 1e3 AS frp,
        CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'N' END AS daynight, 0 AS type FROM orders""",
        [],
    ),
    "rain": (
        f"SELECT {CELL_DAY}, 5e-1 * sum(l_quantity) AS mm FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
        [],
    ),
    "temperature_raw": (
        f"SELECT {CELL_DAY}, CAST(min(9000 + (l_partkey * l_linenumber * 37) % 10000) AS INTEGER) AS raw FROM lineitem GROUP BY 1, 2",
        [],
    ),
    "temperature": (
        "SELECT cell, day, CASE WHEN raw * 2e-2 BETWEEN 2e2 AND 3.5e2 THEN raw * 2e-2 END AS kelvin FROM temperature_raw",
        ["temperature_raw"],
    ),
    "bands": (
        """SELECT CAST(user_id % 25 AS INTEGER) AS cell, CAST(ts AS DATE) AS day,
        CASE event_type WHEN 'click' THEN 'red' WHEN 'view' THEN 'nir' WHEN 'purchase' THEN 'blue'
        WHEN 'signup' THEN 'swir1' WHEN 'error' THEN 'swir2' END AS band,
        CAST(round(avg(value) * 20) AS INTEGER) AS raw FROM events GROUP BY 1, 2, 3""",
        [],
    ),
    "daily_bands": (
        f"""SELECT {CELL_DAY}, CASE (l_linenumber - 1) % 5 + 1 WHEN 1 THEN 'red' WHEN 2 THEN 'nir' WHEN 3 THEN 'blue'
        WHEN 4 THEN 'swir1' WHEN 5 THEN 'swir2' END AS band, CAST(sum(l_partkey * 37) % 9973 AS INTEGER) AS raw
        FROM lineitem GROUP BY 1, 2, 3""",
        [],
    ),
    "index_points": (
        """SELECT event_id AS pid, CAST(user_id % 25 AS INTEGER) AS cell,
        CAST(ts AS DATE) - CAST(event_id % 15 AS INTEGER) AS dtw_start, CAST(ts AS DATE) AS dtw_end FROM events""",
        [],
    ),
    "elevation": (
        "SELECT CAST(floor(p_partkey / 5e1) AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, p_retailprice AS elevation FROM part",
        [],
    ),
    "scores": (
        "SELECT o_orderkey AS pid, round(o_totalprice / 1e3) AS score, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_orderdate AS DATE) AS date FROM orders",
        [],
    ),
    "probabilities": (
        "SELECT pid, score / 5e2 AS p, y, CAST(score / 5e2 >= 5e-1 AS INTEGER) AS yhat FROM scores",
        ["scores"],
    ),
    "labelled_lines": (
        "SELECT l_orderkey * 8 + l_linenumber AS pid, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem",
        [],
    ),
    "requests": (
        """SELECT pid, CASE WHEN pid % 10 = 1 THEN lat + 10 ELSE lat END AS lat, lon,
        CASE pid % 10 WHEN 0 THEN '2999-01-01' WHEN 2 THEN 'bad' ELSE CAST(date AS VARCHAR) END AS date,
        cell, terrain_row, terrain_col FROM anchors""",
        ["anchors"],
    ),
    "gappy_matrix": (
        """SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS f1,
        CASE WHEN o_orderkey % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN CAST('-inf' AS DOUBLE)
        WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 2.5e-1 END AS f2, CAST(NULL AS DOUBLE) AS f3,
        o_orderstatus = 'F' AS is_fire, CAST(o_orderdate AS DATE) AS date FROM orders""",
        [],
    ),
    # One row per window, straight from the definition: running rain of the wet days before the date,
    # newest first; the newest day at which it reaches the threshold ends the walk.
    "windows": (
        """SELECT cell, date, coalesce(hit + 1, date - 90) AS dtw_start, date AS dtw_end,
        CAST(date - coalesce(hit + 1, date - 90) AS INTEGER) AS dtw_length
        FROM (SELECT DISTINCT cell, date FROM anchors) a LEFT JOIN (
          SELECT cell, date, max(day) AS hit FROM (
            SELECT k.cell, k.date, r.day, sum(r.mm) OVER (PARTITION BY k.cell, k.date ORDER BY r.day DESC) AS total
            FROM (SELECT DISTINCT cell, date FROM anchors) k JOIN rain r
            ON k.cell = r.cell AND r.day BETWEEN k.date - 90 AND k.date - 1 WHERE r.mm >= 10
          ) t WHERE total >= 30 GROUP BY 1, 2
        ) h USING (cell, date)""",
        ["anchors", "rain"],
    ),
    "windowed": (
        "SELECT a.*, w.dtw_start, w.dtw_end, w.dtw_length FROM anchors a JOIN windows w USING (cell, date)",
        ["anchors", "windows"],
    ),
    "wide_bands": (
        """SELECT cell, day, CAST(max(raw) FILTER (band = 'red') AS DOUBLE) AS red, CAST(max(raw) FILTER (band = 'nir') AS DOUBLE) AS nir,
        CAST(max(raw) FILTER (band = 'blue') AS DOUBLE) AS blue, CAST(max(raw) FILTER (band = 'swir1') AS DOUBLE) AS swir1,
        CAST(max(raw) FILTER (band = 'swir2') AS DOUBLE) AS swir2 FROM bands GROUP BY 1, 2 HAVING count(*) >= 4""",
        ["bands"],
    ),
    "indices": (
        """SELECT cell, day, (nir - red) / nullif(nir + red, 0) AS ndvi,
        25e-1 * (nir - red) / nullif(nir + 6 * red - 75e-1 * blue + 1, 0) AS evi,
        (nir - swir1) / nullif(nir + swir1, 0) AS ndwi
        FROM (SELECT cell, day, red / 1e4 AS red, nir / 1e4 AS nir, blue / 1e4 AS blue, swir1 / 1e4 AS swir1 FROM wide_bands)""",
        ["wide_bands"],
    ),
}


def ctes(*names: str) -> str:
    """``WITH`` clause with the named sources and all they build on, each once, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in SOURCES[name][1]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{name} AS ({SOURCES[name][0]})" for name in ordered) + " "
