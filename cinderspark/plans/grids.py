"""Grid, tile, value, calendar and risk expressions over the test tables."""

from pyspark.sql import functions as F

from cinderspark.functions import calendar, grid, risk, values
from cinderspark.operators import bands as band_ops
from cinderspark.params import CONFIGURED_REGION, FEATURES, REGION, Grid
from cinderspark.plans import fixtures as fx
from cinderspark.plans.core import KEY, indices, rounded
from cinderspark.plans.places import BOXES_SQL, IN_BOX, SIMPLE_TILE_SQL
from cinderspark.plans.registry import query

RAIN_GRID = Grid(x0=77.5, y0=31.5, dx=0.05, dy=0.05, nrows=56, ncols=70)
X_SQL, Y_SQL = "6371007.181e0 * radians(lon) * cos(radians(lat))", "6371007.181e0 * radians(lat)"
H_SQL = f"CAST(floor(({X_SQL} - -20015109.354e0) / 1111950.5197e0) AS BIGINT)"
V_SQL = f"CAST(floor((10007554.677e0 - {Y_SQL}) / 1111950.5197e0) AS BIGINT)"
ROW_SQL, COL_SQL = "CAST(floor((315e-1 - lat) / 5e-2) AS BIGINT)", "CAST(floor((lon - 775e-1) / 5e-2) AS BIGINT)"


@query("g1_lonlat_to_cell", fx.ctes("requests") + f"SELECT pid, {ROW_SQL} AS row, {COL_SQL} AS col FROM requests")
def g1(spark, folder):
    return fx.requests(spark, folder).select(
        "pid", grid.grid_row(F.col("lat"), RAIN_GRID).alias("row"), grid.grid_col(F.col("lon"), RAIN_GRID).alias("col")
    )


@query(
    "g2_in_grid",
    fx.ctes("requests")
    + f"SELECT pid, {ROW_SQL} >= 0 AND {ROW_SQL} < 56 AND {COL_SQL} >= 0 AND {COL_SQL} < 70 AS inside FROM requests",
)
def g2(spark, folder):
    row, col = grid.grid_row(F.col("lat"), RAIN_GRID), grid.grid_col(F.col("lon"), RAIN_GRID)
    return fx.requests(spark, folder).select("pid", grid.in_grid(row, col, RAIN_GRID).alias("inside"))


@query("g3_sinusoidal", fx.ctes("anchors") + f"SELECT pid, round({X_SQL}, 3) AS x, round({Y_SQL}, 3) AS y FROM anchors")
def g3(spark, folder):
    return rounded(
        fx.anchors(spark, folder).select("pid", grid.sinusoidal_x(F.col("lat"), F.col("lon")).alias("x"), grid.sinusoidal_y(F.col("lat")).alias("y")), 3
    )


@query("g4_simple_tile", fx.ctes("requests") + f"SELECT pid, {SIMPLE_TILE_SQL} AS tile FROM requests")
def g4(spark, folder):
    return fx.requests(spark, folder).select("pid", grid.simple_tile(F.col("lat"), F.col("lon")).alias("tile"))


@query(
    "g5_neighbour_tiles",
    fx.ctes("requests")
    + """SELECT pid, CAST((dh + 1) * 3 + dv + 1 AS INTEGER) AS ord, printf('h%02dv%02d', CAST(h AS INTEGER), CAST(v AS INTEGER)) AS tile
    FROM (SELECT pid, dh, dv, trunc((lon + 180) / 10) + dh AS h, trunc((90 - lat) / 10) + dv AS v
      FROM requests, (VALUES (-1), (0), (1)) a(dh), (VALUES (-1), (0), (1)) b(dv)) WHERE h BETWEEN 0 AND 35 AND v BETWEEN 0 AND 17""",
)
def g5(spark, folder):
    return grid.neighbour_tiles(fx.requests(spark, folder), "lat", "lon").select("pid", "ord", "tile")


@query(
    "g6_tile_by_box",
    fx.ctes("requests")
    + f", {BOXES_SQL} SELECT pid, (SELECT arg_min(tile, ord) FROM tile_boxes WHERE {IN_BOX}) AS tile FROM requests",
)
def g6(spark, folder):
    from cinderspark.operators.spatial import first_tile

    return first_tile(fx.requests(spark, folder)).select("pid", "tile")


@query(
    "g7_exact_tile",
    fx.ctes("requests") + f"SELECT pid, printf('h%02dv%02d', {H_SQL}, {V_SQL}) AS tile FROM requests",
)
def g7(spark, folder):
    return fx.requests(spark, folder).select("pid", grid.exact_tile(F.col("lat"), F.col("lon")).alias("tile"))


@query(
    "g8_tiles_covering_box",
    fx.ctes("anchors")
    + f""", b AS (SELECT cell, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM anchors GROUP BY 1)
    SELECT DISTINCT cell, {SIMPLE_TILE_SQL} AS tile FROM (SELECT cell, s + i * (n - s) / 9 AS lat, w + j * (e - w) / 9 AS lon
      FROM b, range(10) a(i), range(10) c(j))""",
)
def g8(spark, folder):
    boxes = fx.anchors(spark, folder).groupBy("cell").agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")
    )
    return grid.tiles_covering(boxes, "s", "n", "w", "e").select("cell", "tile")


@query(
    "g8_tiles_at_corners",
    fx.ctes("anchors")
    + f""", b AS (SELECT cell, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM anchors GROUP BY 1)
    SELECT DISTINCT cell, {SIMPLE_TILE_SQL} AS tile FROM (SELECT cell, CASE WHEN i = 0 THEN s ELSE n END AS lat, CASE WHEN j = 0 THEN w ELSE e END AS lon
      FROM b, range(2) a(i), range(2) c(j))""",
)
def g8_corners(spark, folder):
    boxes = fx.anchors(spark, folder).groupBy("cell").agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")
    )
    return grid.tiles_covering(boxes, "s", "n", "w", "e", samples=2).select("cell", "tile")


@query(
    "g9_tile_to_box",
    fx.ctes("requests")
    + f"""SELECT DISTINCT tile, CAST(h * 10 - 180 AS DOUBLE) AS lon_min, CAST(h * 10 - 170 AS DOUBLE) AS lon_max,
    CAST(80 - v * 10 AS DOUBLE) AS lat_min, CAST(90 - v * 10 AS DOUBLE) AS lat_max
    FROM (SELECT {SIMPLE_TILE_SQL} AS tile, trunc((lon + 180) / 10) AS h, trunc((90 - lat) / 10) AS v FROM requests)""",
)
def g9(spark, folder):
    tiles = fx.requests(spark, folder).select(grid.simple_tile(F.col("lat"), F.col("lon")).alias("tile")).distinct()
    names = ["lon_min", "lon_max", "lat_min", "lat_max"]
    return tiles.select("tile", *[c.alias(n) for n, c in zip(names, grid.tile_lonlat_box(F.col("tile")))])


@query(
    "g10_planar_distance",
    fx.ctes("anchors")
    + """SELECT a.pid, round(sqrt((a.lat - c.lat) * (a.lat - c.lat) + (a.lon - c.lon) * (a.lon - c.lon)) * 111, 6) AS km FROM anchors a
    JOIN (SELECT cell, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon FROM anchors GROUP BY 1) c USING (cell)""",
)
def g10(spark, folder):
    from cinderspark.operators.skew import lookup

    points = fx.anchors(spark, folder)
    centres = points.groupBy("cell").agg(
        ((F.min("lat") + F.max("lat")) / 2).alias("c_lat"), ((F.min("lon") + F.max("lon")) / 2).alias("c_lon")
    )
    km = grid.planar_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return rounded(lookup(points.select("pid", "lat", "lon", "cell"), centres, ["cell"]).select("pid", km.alias("km")))


@query(
    "g11_bbox_filter",
    fx.ctes("anchors")
    + "SELECT pid, lat, lon FROM anchors WHERE lat BETWEEN 28.709556e0 AND 31.459016e0 AND lon BETWEEN 77.575402e0 AND 81.044789e0",
)
def g11(spark, folder):
    return fx.anchors(spark, folder).where(grid.within(F.col("lat"), F.col("lon"), CONFIGURED_REGION)).select("pid", "lat", "lon")


DEM_SQL = """, d AS (SELECT DISTINCT CAST(floor(lat) AS BIGINT) AS south, CAST(floor(lon) AS BIGINT) AS west FROM requests),
  i AS (SELECT south, west, west <= 80 AND west + 1 >= 78 AND south <= 30 AND south + 1 >= 29 AS intersects FROM d)"""


def dem_tiles(spark, folder):
    """One-degree tiles under the requests, and whether they meet a region."""
    tiles = fx.requests(spark, folder).select(F.floor(F.col("lat")).alias("south"), F.floor(F.col("lon")).alias("west")).distinct()
    region = tuple(F.lit(x) for x in (78, 80, 29, 30))
    mine = (F.col("west"), F.col("west") + 1, F.col("south"), F.col("south") + 1)
    return tiles.withColumn("intersects", grid.boxes_overlap(mine, region))


@query("g12_dem_tile_coverage", fx.ctes("requests") + DEM_SQL + "SELECT * FROM i")
def g12(spark, folder):
    return dem_tiles(spark, folder)


@query(
    "g12_dem_union_bounds",
    fx.ctes("requests")
    + DEM_SQL
    + "SELECT min(west) AS lon_min, max(west + 1) AS lon_max, min(south) AS lat_min, max(south + 1) AS lat_max, count(*) AS n_tiles FROM i WHERE intersects",
)
def g12_bounds(spark, folder):
    return dem_tiles(spark, folder).where("intersects").agg(
        F.min("west").alias("lon_min"), F.max(F.col("west") + 1).alias("lon_max"),
        F.min("south").alias("lat_min"), F.max(F.col("south") + 1).alias("lat_max"), F.count("*").alias("n_tiles"),
    )


TILE_EDGES_SQL = f"""(SELECT DISTINCT tile, -20015109.354e0 + h * 1111950.5197e0 AS x0, -20015109.354e0 + h * 1111950.5197e0 + 1111950.5197e0 AS x1,
  10007554.677e0 - v * 1111950.5197e0 - 1111950.5197e0 AS y0, 10007554.677e0 - v * 1111950.5197e0 AS y1
  FROM (SELECT printf('h%02dv%02d', {H_SQL}, {V_SQL}) AS tile, {H_SQL} AS h, {V_SQL} AS v FROM requests))"""


@query(
    "g12_projected_overlap",
    fx.ctes("requests")
    + f""", r AS (SELECT min(x) AS rx0, max(x) AS rx1, min(y) AS ry0, max(y) AS ry1 FROM (SELECT {X_SQL} AS x, {Y_SQL} AS y FROM anchors))
    SELECT tile, x0 <= rx1 AND x1 >= rx0 AND y0 <= ry1 AND y1 >= ry0 AS overlaps FROM {TILE_EDGES_SQL}, r""",
)
def g12_projected(spark, folder):
    tiles = fx.requests(spark, folder).select(grid.exact_tile(F.col("lat"), F.col("lon")).alias("tile")).distinct()
    x, y = grid.sinusoidal_x(F.col("lat"), F.col("lon")), grid.sinusoidal_y(F.col("lat"))
    box = fx.anchors(spark, folder).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    overlap = grid.boxes_overlap(grid.tile_projected_bounds(F.col("tile")), tuple(F.lit(v) for v in box))
    return tiles.select("tile", overlap.alias("overlaps"))


def lon_sql(x: str, y: str) -> str:
    return f"degrees({x} / (6371007.181e0 * cos({y} / 6371007.181e0)))"


LONS_SQL = ", ".join(lon_sql(x, y) for x in ("x0", "x1") for y in ("y0", "y1"))


@query(
    "g13_tile_geographic_bounds",
    fx.ctes("requests")
    + f"""SELECT tile, round(least({LONS_SQL}), 6) AS lon_min, round(greatest({LONS_SQL}), 6) AS lon_max,
    round(degrees(y0 / 6371007.181e0), 6) AS lat_min, round(degrees(y1 / 6371007.181e0), 6) AS lat_max FROM {TILE_EDGES_SQL}""",
)
def g13(spark, folder):
    tiles = fx.requests(spark, folder).select(grid.exact_tile(F.col("lat"), F.col("lon")).alias("tile")).distinct()
    names = ["lon_min", "lon_max", "lat_min", "lat_max"]
    return rounded(tiles.select("tile", *[c.alias(n) for n, c in zip(names, grid.tile_geographic_bounds(F.col("tile")))]))


@query(
    "v1_rain_value",
    fx.ctes("anchors", "rain")
    + "SELECT pid, coalesce(CASE WHEN mm <> 25 THEN mm END, 0) AS mm FROM anchors a LEFT JOIN rain r ON a.cell = r.cell AND a.date = r.day",
)
def v1(spark, folder):
    from cinderspark.operators.spatial import sample_cells

    rain = fx.rain(spark, folder).withColumnRenamed("day", "date")
    found = sample_cells(fx.anchors(spark, folder), rain, ["cell", "date"], ["mm"])
    return found.select("pid", values.rain_mm(F.col("mm"), nodata=25.0).alias("mm"))


@query("v2_temperature_value", fx.ctes("temperature") + "SELECT cell, day, round(kelvin, 6) AS kelvin FROM temperature")
def v2(spark, folder):
    raw = fx.temperature_raw(spark, folder)
    return rounded(raw.select("cell", "day", values.temperature_k(F.col("raw")).alias("kelvin")))


@query(
    "v3_reflectance_value",
    fx.ctes("daily_bands") + "SELECT cell, day, band, round(CASE WHEN raw <> 7 THEN raw / 1e4 END, 6) AS reflectance FROM daily_bands",
)
def v3(spark, folder):
    return rounded(
        fx.daily_bands(spark, folder).select("cell", "day", "band", values.reflectance(F.col("raw"), 7).alias("reflectance"))
    )


@query(
    "v4_terrain_value",
    fx.ctes("elevation") + "SELECT row, col, CASE WHEN elevation <> 9e2 THEN elevation END AS elevation FROM elevation",
)
def v4(spark, folder):
    return fx.elevation(spark, folder).select("row", "col", values.terrain_value(F.col("elevation"), 900.0).alias("elevation"))


INDEX_OUT = "round(ndvi, 6) AS ndvi, round(evi, 6) AS evi, round(ndwi, 6) AS ndwi"


@query("v5_indices_strict", fx.ctes("indices") + f"SELECT cell, day, {INDEX_OUT} FROM indices")
def v5(spark, folder):
    return rounded(indices(spark, folder))


POSITIVE_SQL = """SELECT cell, day, CASE WHEN red > 0 AND nir > 0 THEN (nir - red) / (nir + red) END AS ndvi,
  CASE WHEN red > 0 AND nir > 0 AND blue > 0 THEN 25e-1 * (nir - red) / (nir + 6 * red - 75e-1 * blue + 1) END AS evi,
  CASE WHEN nir > 0 AND swir1 > 0 THEN (nir - swir1) / (nir + swir1) END AS ndwi
  FROM (SELECT cell, day, red / 1e4 AS red, nir / 1e4 AS nir, blue / 1e4 AS blue, swir1 / 1e4 AS swir1 FROM wide_bands)"""


@query("v6_indices_positive", fx.ctes("wide_bands") + f"SELECT cell, day, {INDEX_OUT} FROM ({POSITIVE_SQL})")
def v6(spark, folder):
    return rounded(indices(spark, folder, "positive"))


@query("v7_band_assembly", fx.ctes("wide_bands") + "SELECT * FROM wide_bands")
def v7(spark, folder):
    return band_ops.assemble(fx.bands(spark, folder), KEY, "day")


@query(
    "v8_indices_at_points",
    fx.ctes("index_points", "indices")
    + f"""SELECT pid, w.red, w.nir, w.blue, w.swir1, w.swir2, {INDEX_OUT} FROM index_points p
    LEFT JOIN wide_bands w ON p.cell = w.cell AND p.dtw_end = w.day LEFT JOIN indices i ON p.cell = i.cell AND p.dtw_end = i.day""",
)
def v8(spark, folder):
    from cinderspark.operators.spatial import sample_cells

    wide = band_ops.assemble(fx.bands(spark, folder), KEY, "day")
    made = band_ops.indices_per_day(wide, keep_bands=True).withColumnRenamed("day", "dtw_end")
    columns = [*band_ops.BANDS, "ndvi", "evi", "ndwi"]
    return rounded(sample_cells(fx.index_points(spark, folder), made, ["cell", "dtw_end"], columns).select("pid", *columns))


@query(
    "k1_day_of_year",
    fx.ctes("anchors")
    + "SELECT pid, CAST(year(date) AS INTEGER) AS year, lpad(CAST(dayofyear(date) AS VARCHAR), 3, '0') AS doy FROM anchors",
)
def k1(spark, folder):
    day = F.col("date")
    return fx.anchors(spark, folder).select("pid", F.year(day).alias("year"), calendar.day_of_year_text(day).alias("doy"))


YEARS_SQL = ", y AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM anchors)"


@query(
    "k2_season_month_ranges",
    fx.ctes("anchors")
    + YEARS_SQL
    + """SELECT year, season, make_date(year, m, 1) AS first_day, last_day(make_date(year, m, 1)) AS last_day
    FROM y, (VALUES ('temperature', 2, 6), ('reflectance', 3, 5), ('reflectance_complete', 1, 6)) s(season, a, b), range(1, 13) r(m) WHERE m BETWEEN a AND b""",
)
def k2(spark, folder):
    years = fx.anchors(spark, folder).select(F.year("date").alias("year")).distinct()
    parts = [
        years.select(
            "year", F.lit(name).alias("season"), F.explode(calendar.month_starts(F.col("year"), *months)).alias("first_day")
        )
        for name, months in calendar.SEASONS.items()
    ]
    ranges = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ranges.withColumn("last_day", F.last_day("first_day"))


@query(
    "k2_season_days",
    fx.ctes("anchors")
    + YEARS_SQL
    + """SELECT year, CAST(d AS DATE) AS day FROM (SELECT year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 6, 30), INTERVAL 1 DAY)) AS d FROM y)""",
)
def k2_days(spark, folder):
    years = fx.anchors(spark, folder).select(F.year("date").alias("year")).distinct()
    return years.select("year", F.explode(calendar.season_days(F.col("year"), 1, 6)).alias("day"))


RISK_SQL = "CASE WHEN p < 3e-1 THEN 'Low' WHEN p < 6e-1 THEN 'Medium' WHEN p < 8e-1 THEN 'High' ELSE 'Very High' END"


@query(
    "p1_risk_band",
    fx.ctes("probabilities") + f"SELECT pid, {RISK_SQL} AS risk_level, round(abs(p - 5e-1) * 2, 6) AS confidence FROM probabilities",
)
def p1(spark, folder):
    p = F.col("p")
    return rounded(
        fx.probabilities(spark, folder).select("pid", risk.risk_level(p).alias("risk_level"), risk.confidence(p).alias("confidence"))
    )


@query(
    "p2_request_checks",
    fx.ctes("requests")
    + """SELECT pid, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude out of range' WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude out of range'
    WHEN try_cast(date AS DATE) IS NULL THEN 'invalid date' WHEN try_cast(date AS DATE) > DATE '2026-01-01' THEN 'date in the future'
    WHEN try_cast(date AS DATE) > DATE '2000-12-31' THEN 'date after the last data day'
    WHEN NOT (lat BETWEEN 287e-1 AND 315e-1 AND lon BETWEEN 775e-1 AND 81) THEN 'outside the region' END AS error FROM requests""",
)
def p2(spark, folder):
    today = F.lit("2026-01-01").cast("date")
    error = risk.request_error(F.col("lat"), F.col("lon"), F.col("date"), today, REGION, last_day="2000-12-31")
    return fx.requests(spark, folder).select("pid", error.alias("error"))


@query(
    "p3_column_completion",
    fx.ctes("anchors", "elevation")
    + "SELECT pid, "
    + ", ".join("e.elevation AS elevation" if c == "elevation" else f"CAST(NULL AS DOUBLE) AS {c}" for c in FEATURES)
    + " FROM anchors a LEFT JOIN elevation e ON a.terrain_row = e.row AND a.terrain_col = e.col",
)
def p3(spark, folder):
    from cinderspark.operators.clean import complete_columns
    from cinderspark.plans.places import j1_static

    return complete_columns(j1_static(spark, folder), FEATURES, ["pid"])


@query(
    "p4_risk_advice",
    fx.ctes("probabilities")
    + ", advice(risk_level, colour, advice) AS (VALUES "
    + ", ".join(f"('{level}', '{colour}', '{text}')" for level, colour, text in risk.ADVICE)
    + f") SELECT pid, risk_level, colour, advice FROM (SELECT pid, {RISK_SQL} AS risk_level FROM probabilities) JOIN advice USING (risk_level)",
)
def p4(spark, folder):
    scored = fx.probabilities(spark, folder).select("pid", risk.risk_level(F.col("p")).alias("risk_level"))
    # Four rows, one per band.
    return scored.join(F.broadcast(risk.advice_table(spark)), "risk_level")


NAMES_SQL = """names AS (SELECT DISTINCT lower(p_type) || '_' || s AS name FROM part, (VALUES ('prec_min'), ('lst_median'), ('ndvi_mean'), ('evi_max'), ('ndwi_min'), ('prec_sum'), ('slope')) v(s)
  UNION SELECT s FROM (VALUES ('elevation'), ('slope'), ('aspect')) v(s) UNION SELECT DISTINCT lower(replace(p_brand, '#', '')) FROM part)"""


def feature_names(spark, folder):
    """Names with and without feature parts, made out of part types and brands."""
    part = fx.table(spark, folder, "part")
    parts = F.explode(F.array(*[F.lit(s) for s in ["prec_min", "lst_median", "ndvi_mean", "evi_max", "ndwi_min", "prec_sum", "slope"]]))
    typed = part.select(F.lower("p_type").alias("t"), parts.alias("s")).select(F.concat_ws("_", "t", "s").alias("name"))
    static = part.select(F.explode(F.array(*[F.lit(s) for s in risk.STATIC_FEATURES])).alias("name"))
    brands = part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"))
    return typed.union(static).union(brands).distinct()


@query(
    "x1_feature_categories",
    f"WITH {NAMES_SQL}"
    + """SELECT name, CASE WHEN contains(name, 'prec') THEN 'Precipitation' WHEN contains(name, 'lst') THEN 'Temperature'
    WHEN contains(name, 'ndvi') THEN 'Vegetation (NDVI)' WHEN contains(name, 'evi') THEN 'Vegetation (EVI)' WHEN contains(name, 'ndwi') THEN 'Moisture (NDWI)'
    WHEN name IN ('elevation', 'slope', 'aspect') THEN 'Terrain' ELSE 'Other' END AS category,
    CASE WHEN contains(name, 'min') THEN 'Min' WHEN contains(name, 'median') THEN 'Median' WHEN contains(name, 'mean') THEN 'Mean'
    WHEN contains(name, 'max') THEN 'Max' WHEN contains(name, 'sum') THEN 'Sum' ELSE 'Static' END AS statistic FROM names""",
)
def x1(spark, folder):
    name = F.col("name")
    return feature_names(spark, folder).select(
        "name", risk.feature_category(name).alias("category"), risk.feature_statistic(name).alias("statistic")
    )
