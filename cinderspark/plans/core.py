"""Look-back windows, daily series and window statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.functions.values import temperature_k
from cinderspark.operators import bands as band_ops
from cinderspark.operators import lookback, windowstats
from cinderspark.operators.sampling import draw
from cinderspark.operators.skew import lookup
from cinderspark.plans import fixtures as fx
from cinderspark.plans.registry import draw_sql, query

KEY = ["cell"]
ON = ["cell", "date"]
GIVEN = ["cell", "dtw_start", "dtw_end"]


def windowed(spark: SparkSession, folder: str) -> DataFrame:
    return lookback.backward_threshold_window(fx.anchors(spark, folder), fx.rain(spark, folder), KEY, "day", "mm")


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of the distinct (cell, date)."""
    return lookback.window_per_key(fx.anchors(spark, folder), fx.rain(spark, folder), KEY, "date", "day", "mm")


def temperature(spark: SparkSession, folder: str) -> DataFrame:
    raw = fx.temperature_raw(spark, folder)
    return raw.select("cell", "day", temperature_k(F.col("raw")).alias("kelvin"))


def indices(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    return band_ops.indices_per_day(band_ops.assemble(fx.bands(spark, folder), KEY, "day"), mode)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


STAT_NAMES = ["min", "median", "mean", "max"]


def stats_sql(value: str, prefix: str, with_sum: bool = False) -> str:
    functions = {"min": "min", "median": "median", "mean": "avg", "max": "max", **({"sum": "sum"} if with_sum else {})}
    return ", ".join(f"round({f}({value}), 6) AS {prefix}_{name}" for name, f in functions.items())


@query("t1_backward_window", fx.ctes("windows") + "SELECT cell, date, dtw_start, dtw_end, dtw_length FROM windows")
def t1(spark, folder):
    return windows(spark, folder)


@query("t2_batch_windows", fx.ctes("windowed") + "SELECT pid, lat, lon, date, cell, is_fire, dtw_start, dtw_end, dtw_length FROM windowed")
def t2(spark, folder):
    return windowed(spark, folder).select(
        "pid", "lat", "lon", "date", "cell", "is_fire", "dtw_start", "dtw_end", "dtw_length"
    )


@query(
    "t3_window_with_fallback",
    fx.ctes("windows")
    + """SELECT pid, date, coalesce(w.dtw_start, a.date - 30) AS dtw_start, a.date AS dtw_end,
    CAST(a.date - coalesce(w.dtw_start, a.date - 30) AS INTEGER) AS dtw_length
    FROM anchors a LEFT JOIN (SELECT * FROM windows WHERE cell IN (SELECT cell FROM rain GROUP BY 1 HAVING count(*) >= 200)) w USING (cell, date)""",
)
def t3(spark, folder):
    a, rain = fx.anchors(spark, folder), fx.rain(spark, folder)
    measured = rain.groupBy("cell").count().where("count >= 200").select("cell")
    found = windows(spark, folder).join(measured, "cell", "left_semi")
    return lookback.with_fallback(a, found, KEY).select("pid", "date", "dtw_start", "dtw_end", "dtw_length")


FALLBACK_SQL = f"CAST(7 + {draw_sql('42:fallback')} % 23 AS INTEGER)"


@query(
    "t3_window_random_fallback",
    fx.ctes("windows")
    + f"""SELECT pid, date, a.date - {FALLBACK_SQL} AS dtw_start, a.date AS dtw_end, {FALLBACK_SQL} AS dtw_length FROM anchors a WHERE cell NOT IN (SELECT cell FROM rain WHERE mm >= 100)
    UNION ALL SELECT pid, date, dtw_start, dtw_end, dtw_length FROM windows JOIN anchors USING (cell, date) WHERE cell IN (SELECT cell FROM rain WHERE mm >= 100)""",
)
def t3_random(spark, folder):
    a, rain = fx.anchors(spark, folder), fx.rain(spark, folder)
    measured = rain.where("mm >= 100").select("cell").distinct()
    found = windows(spark, folder).join(measured, "cell", "left_semi")
    days = (F.lit(7) + draw(F.col("pid"), "42:fallback") % 23).cast("int")
    return lookback.with_fallback(a, found, KEY, days=days).select("pid", "date", "dtw_start", "dtw_end", "dtw_length")


@query(
    "t4_daily_rain",
    fx.ctes("windowed")
    + """SELECT pid, d.day AS day, coalesce(r.mm, 0) AS mm FROM (
      SELECT pid, cell, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 1 DAY)) AS DATE) AS day FROM windowed) d
    LEFT JOIN rain r ON d.cell = r.cell AND d.day = r.day""",
)
def t4(spark, folder):
    arrays = lookback.daily_arrays(windows(spark, folder), fx.rain(spark, folder), KEY, "day", ["mm"], fill=0.0)
    return lookback.daily_values(fx.anchors(spark, folder), arrays, ON).select("pid", "day", "mm")


@query(
    "t5_daily_temperature",
    fx.ctes("windowed", "temperature")
    + """SELECT pid, d.day AS day, round(r.kelvin, 6) AS kelvin FROM (
      SELECT pid, cell, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 1 DAY)) AS DATE) AS day FROM windowed) d
    LEFT JOIN temperature r ON d.cell = r.cell AND d.day = r.day""",
)
def t5(spark, folder):
    arrays = lookback.daily_arrays(windows(spark, folder), temperature(spark, folder), KEY, "day", ["kelvin"])
    series = lookback.daily_values(fx.anchors(spark, folder), arrays, ON)
    return rounded(series.select("pid", "day", "kelvin"))


@query(
    "t6_third_day_vegetation",
    fx.ctes("index_points", "indices")
    + """SELECT pid, d.day AS day, round(ndvi, 6) AS ndvi, round(evi, 6) AS evi, round(ndwi, 6) AS ndwi FROM (
      SELECT pid, cell, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 3 DAY)) AS DATE) AS day FROM index_points) d
    LEFT JOIN indices r ON d.cell = r.cell AND d.day = r.day""",
)
def t6(spark, folder):
    points = fx.index_points(spark, folder)
    given = points.select(*GIVEN).distinct()
    arrays = lookback.daily_arrays(given, indices(spark, folder), KEY, "day", ["ndvi", "evi", "ndwi"], step_days=3)
    series = lookback.daily_values(points, arrays, GIVEN)
    return rounded(series.select("pid", "day", "ndvi", "evi", "ndwi"))


@query(
    "t7_window_report",
    fx.ctes("windowed")
    + """SELECT pid, window_length_days, total_mm, max_daily_mm, wet_days, cum_min, daily_min, max_days, n_series, series_text
    FROM anchors JOIN (SELECT w.cell, w.date, CAST(max(w.dtw_length) AS INTEGER) AS window_length_days, round(sum(coalesce(r.mm, 0)), 6) AS total_mm,
      max(coalesce(r.mm, 0)) AS max_daily_mm, CAST(count(*) FILTER (r.mm >= 10) AS INTEGER) AS wet_days,
      3e1 AS cum_min, 1e1 AS daily_min, 90 AS max_days, CAST(count(*) AS INTEGER) AS n_series,
      string_agg(CAST(w.day AS VARCHAR) || '=' || CAST(CAST(round(coalesce(r.mm, 0) * 10) AS BIGINT) AS VARCHAR), ';' ORDER BY w.day) AS series_text
      FROM (SELECT DISTINCT cell, date, dtw_length, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 1 DAY)) AS DATE) AS day FROM windows) w
      LEFT JOIN rain r ON w.cell = r.cell AND w.day = r.day GROUP BY 1, 2) USING (cell, date)""",
)
def t7(spark, folder):
    report = lookback.window_report(windows(spark, folder), fx.rain(spark, folder), KEY, "day", "mm")
    entries = F.transform(
        F.map_entries("series"),
        lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.round(e["value"] * 10).cast("bigint").cast("string")),
    )
    texts = rounded(
        report.select(
            "cell", "date", "window_length_days", "total_mm", "max_daily_mm", "wet_days", "cum_min", "daily_min", "max_days",
            F.size("series").alias("n_series"), F.array_join(entries, ";").alias("series_text"),
        )
    )
    return lookup(fx.anchors(spark, folder).select("pid", *ON), texts, ON).drop(*ON)


DAY_ROWS = """(SELECT cell, date, dtw_start, dtw_end, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 1 DAY)) AS DATE) AS day FROM windows)"""


@query(
    "a1_rain_statistics",
    fx.ctes("windowed")
    + f"""SELECT pid, n_missing, prec_min, prec_median, prec_mean, prec_max, prec_sum FROM anchors JOIN (
      SELECT d.cell, d.date, CAST(count(*) - count(r.mm) AS INTEGER) AS n_missing, {stats_sql("coalesce(r.mm, 0)", "prec", True)}
      FROM {DAY_ROWS} d LEFT JOIN rain r ON d.cell = r.cell AND d.day = r.day GROUP BY 1, 2) USING (cell, date)""",
)
def a1(spark, folder):
    statistics = windowstats.rain_statistics(windows(spark, folder), fx.rain(spark, folder), KEY)
    out = windowstats.add_statistics(fx.anchors(spark, folder), statistics, ON)
    return rounded(out.select("pid", "n_missing", "prec_min", "prec_median", "prec_mean", "prec_max", "prec_sum"))


@query(
    "a2_temperature_statistics",
    fx.ctes("windowed", "temperature")
    + f"""SELECT cell, dtw_start, dtw_end, lst_min, lst_median, lst_mean, lst_max FROM (
      SELECT d.cell, dtw_start, dtw_end, {stats_sql("r.kelvin", "lst")}
      FROM {DAY_ROWS} d LEFT JOIN temperature r ON d.cell = r.cell AND d.day = r.day GROUP BY 1, 2, 3)""",
)
def a2(spark, folder):
    out = windowstats.temperature_statistics(windows(spark, folder), temperature(spark, folder), KEY)
    return rounded(out.drop("date", "dtw_length"))


VEGETATION_SQL = f"""SELECT d.pid, {stats_sql("r.ndvi", "ndvi")}, {stats_sql("r.evi", "evi")}, {stats_sql("r.ndwi", "ndwi")} FROM (
      SELECT pid, cell, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 3 DAY)) AS DATE) AS day FROM index_points) d
    LEFT JOIN indices r ON d.cell = r.cell AND d.day = r.day GROUP BY 1"""
VEGETATION_COLUMNS = [f"{i}_{s}" for i in ("ndvi", "evi", "ndwi") for s in STAT_NAMES]


@query("a3_vegetation_statistics", fx.ctes("index_points", "indices") + VEGETATION_SQL)
def a3(spark, folder):
    points = fx.index_points(spark, folder)
    given = points.select(*GIVEN).distinct()
    out = windowstats.add_statistics(points, windowstats.vegetation_statistics(given, indices(spark, folder), KEY), GIVEN)
    return rounded(out.select("pid", *VEGETATION_COLUMNS))


@query(
    "a18_window_length_statistics",
    fx.ctes("windowed")
    + """SELECT count(dtw_start) AS n_valid, count(*) - count(dtw_start) AS n_failed, round(avg(dtw_length), 6) AS mean_length,
    min(dtw_length) AS min_length, max(dtw_length) AS max_length FROM windowed""",
)
def a18(spark, folder):
    return rounded(
        windowed(spark, folder).agg(
            F.count("dtw_start").alias("n_valid"),
            (F.count("*") - F.count("dtw_start")).alias("n_failed"),
            F.avg("dtw_length").alias("mean_length"),
            F.min("dtw_length").alias("min_length"),
            F.max("dtw_length").alias("max_length"),
        )
    )
