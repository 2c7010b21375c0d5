"""Quality reports, cleaning, terrain and evaluation over the test tables."""

from pyspark.sql import functions as F

from cinderspark.operators import clean, evaluation, quality, spatial, terrain
from cinderspark.operators.skew import lookup
from cinderspark.params import CONFIGURED_REGION, REGION, Box, Grid
from cinderspark.plans import fixtures as fx
from cinderspark.plans.core import rounded
from cinderspark.plans.grids import feature_names
from cinderspark.plans.grids import NAMES_SQL
from cinderspark.plans.places import BOXES_SQL, IN_BOX
from cinderspark.plans.registry import query

# ---- terrain ----

HORN_SQL = """, z AS (SELECT c.row, c.col, c.elevation AS z, nw.elevation AS nw, n.elevation AS n, ne.elevation AS ne, w.elevation AS w, e.elevation AS e,
  sw.elevation AS sw, s.elevation AS s, se.elevation AS se FROM elevation c
  LEFT JOIN elevation nw ON nw.row = c.row - 1 AND nw.col = c.col - 1 LEFT JOIN elevation n ON n.row = c.row - 1 AND n.col = c.col
  LEFT JOIN elevation ne ON ne.row = c.row - 1 AND ne.col = c.col + 1 LEFT JOIN elevation w ON w.row = c.row AND w.col = c.col - 1
  LEFT JOIN elevation e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN elevation sw ON sw.row = c.row + 1 AND sw.col = c.col - 1
  LEFT JOIN elevation s ON s.row = c.row + 1 AND s.col = c.col LEFT JOIN elevation se ON se.row = c.row + 1 AND se.col = c.col + 1),
  g AS (SELECT row, col, z, (ne + 2 * e + se) - (nw + 2 * w + sw) AS a, (sw + 2 * s + se) - (nw + 2 * n + ne) AS b FROM z),
  terrain AS (SELECT row, col, z AS elevation, degrees(atan(sqrt((a / 24e1) * (a / 24e1) + (b / 24e1) * (b / 24e1)))) AS slope,
    CASE WHEN a <> 0 OR b <> 0 THEN ((90 - degrees(atan2(b, -a))) + 720) % 360 END AS aspect FROM g)"""


def terrain_table(spark, folder):
    return terrain.slope_aspect(fx.elevation(spark, folder), xres=30.0, yres=30.0, block=16)


@query("d1_slope", fx.ctes("elevation") + HORN_SQL + "SELECT row, col, round(slope, 6) AS slope FROM terrain")
def d1(spark, folder):
    return rounded(terrain_table(spark, folder).select("row", "col", "slope"))


@query("d2_aspect", fx.ctes("elevation") + HORN_SQL + "SELECT row, col, round(aspect, 6) AS aspect FROM terrain")
def d2(spark, folder):
    return rounded(terrain_table(spark, folder).select("row", "col", "aspect"))


@query(
    "d3_terrain_sample",
    fx.ctes("anchors", "elevation")
    + HORN_SQL
    + "SELECT pid, elevation, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM anchors a LEFT JOIN terrain t ON a.terrain_row = t.row AND a.terrain_col = t.col",
)
def d3(spark, folder):
    found = terrain.sample_terrain(fx.anchors(spark, folder), terrain_table(spark, folder))
    return rounded(found.select("pid", "elevation", "slope", "aspect"))


OVERLAP_SQL = """, tiles AS (SELECT row, col, CASE WHEN (row + col) % 9 = 0 THEN -32768e0 ELSE elevation END AS elevation, 1 AS file_order FROM elevation WHERE row < 30
  UNION ALL SELECT row, col, CASE WHEN (row + col) % 4 = 0 THEN -32768e0 ELSE elevation + 1 END, 2 FROM elevation WHERE row >= 20),
  mosaic AS (SELECT row, col, arg_max(elevation, file_order) AS elevation FROM tiles WHERE elevation <> -32768e0 GROUP BY 1, 2)"""


def overlapping_tiles(spark, folder):
    """Two overlapping elevation tiles with holes."""
    cells, at = fx.elevation(spark, folder), F.col("row") + F.col("col")
    hole = F.lit(-32768.0)
    first = cells.where("row < 30").withColumn("elevation", F.when(at % 9 == 0, hole).otherwise(F.col("elevation")))
    second = cells.where("row >= 20").withColumn("elevation", F.when(at % 4 == 0, hole).otherwise(F.col("elevation") + 1))
    return first.withColumn("file_order", F.lit(1)).unionByName(second.withColumn("file_order", F.lit(2)))


@query("s11_mosaic", fx.ctes("elevation") + OVERLAP_SQL + "SELECT * FROM mosaic")
def s11(spark, folder):
    return terrain.mosaic(overlapping_tiles(spark, folder), nodata=-32768.0)


PART_GRID = Grid(x0=77.5, y0=31.5, dx=0.07, dy=0.07, nrows=40, ncols=50)
PART_BOX = Box(south=29.0, north=31.0, west=78.0, east=80.5)
CLIP_SQL = "315e-1 - (row + 5e-1) * 7e-2 BETWEEN 29e0 AND 31e0 AND 775e-1 + (col + 5e-1) * 7e-2 BETWEEN 78e0 AND 805e-1"


@query("s12_clip_to_box", fx.ctes("elevation") + f"SELECT * FROM elevation WHERE {CLIP_SQL}")
def s12(spark, folder):
    return terrain.clip(fx.elevation(spark, folder), PART_GRID, PART_BOX)


CHAIN_SQL = OVERLAP_SQL + f", clipped AS (SELECT * FROM mosaic WHERE {CLIP_SQL})" + HORN_SQL.replace("elevation c\n", "clipped c\n").replace("JOIN elevation ", "JOIN clipped ")


@query(
    "d4_terrain_chain",
    fx.ctes("elevation") + CHAIN_SQL + "SELECT row, col, elevation, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM terrain",
)
def d4(spark, folder):
    cells = terrain.clip(terrain.mosaic(overlapping_tiles(spark, folder), nodata=-32768.0), PART_GRID, PART_BOX)
    return rounded(terrain.slope_aspect(cells, xres=30.0, yres=30.0, block=16))


@query(
    "a5_raster_statistics",
    fx.ctes("elevation")
    + HORN_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS product, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS n_valid FROM terrain"
        for c in ("elevation", "slope", "aspect")
    ),
)
def a5(spark, folder):
    return rounded(terrain.raster_statistics(terrain_table(spark, folder)))


# ---- quality ----


@query(
    "a7_detection_summary",
    fx.ctes("detections")
    + """SELECT count(*) AS total, min(acq_date) AS first_day, max(acq_date) AS last_day, min(latitude) AS min_lat, max(latitude) AS max_lat,
    min(longitude) AS min_lon, max(longitude) AS max_lon FROM detections""",
)
def a7(spark, folder):
    return quality.detection_summary(fx.detections(spark, folder))


@query(
    "a7_detection_breakdown",
    fx.ctes("detections")
    + """SELECT 'satellite' AS kind, satellite AS value, count(*) AS n FROM detections GROUP BY 2 UNION ALL
    SELECT 'confidence', CAST(confidence AS VARCHAR), count(*) FROM detections GROUP BY 2 UNION ALL
    SELECT 'year', CAST(year(acq_date) AS VARCHAR), count(*) FROM detections GROUP BY 2""",
)
def a7_breakdown(spark, folder):
    return quality.detection_breakdown(fx.detections(spark, folder))


DETECTION_COLUMNS = [
    "latitude", "longitude", "brightness", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence",
    "version", "bright_t31", "frp", "daynight", "type",
]


@query(
    "a8_missing_rates",
    fx.ctes("detections")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 6) AS missing_pct, avg(CAST({c} IS NULL AS INTEGER)) * 100 > 10 AS flagged FROM detections"
        for c in DETECTION_COLUMNS
    ),
)
def a8(spark, folder):
    return rounded(quality.missing_rates(fx.detections(spark, folder)))


@query("a9_distribution_by_value", fx.ctes("detections") + "SELECT confidence, count(*) AS n FROM detections GROUP BY 1 ORDER BY 1")
def a9(spark, folder):
    return quality.value_distribution(fx.detections(spark, folder), "confidence")


@query("a9_distribution_by_count", fx.ctes("detections") + "SELECT satellite, count(*) AS n FROM detections GROUP BY 1 ORDER BY 2 DESC, 1")
def a9_count(spark, folder):
    return quality.value_distribution(fx.detections(spark, folder), "satellite", by_count=True)


DATES_SQL = "min(acq_date) <= DATE '1995-01-01' AND max(acq_date) >= DATE '2001-12-31'"
INSIDE_SQL = "avg(CAST(latitude > 28709556e-6 AND latitude < 31459016e-6 AND longitude > 77575402e-6 AND longitude < 81044789e-6 AS INTEGER)) * 100"


@query("a10_date_coverage", fx.ctes("detections") + f"SELECT min(acq_date) AS first_day, max(acq_date) AS last_day, {DATES_SQL} AS passed FROM detections")
def a10(spark, folder):
    return quality.date_coverage(fx.detections(spark, folder), "1995-01-01", "2001-12-31")


@query("a11_spatial_coverage", fx.ctes("detections") + f"SELECT round({INSIDE_SQL}, 6) AS inside_pct, {INSIDE_SQL} >= 80 AS passed FROM detections")
def a11(spark, folder):
    return rounded(quality.spatial_coverage(fx.detections(spark, folder), CONFIGURED_REGION))


@query(
    "a12_validation",
    fx.ctes("detections")
    + f""", c AS (SELECT {DATES_SQL} AS dates, {INSIDE_SQL} >= 80 AS place FROM detections)
    SELECT 'schema' AS "check", true AS passed FROM c UNION ALL SELECT 'dates', dates FROM c UNION ALL SELECT 'place', place FROM c
    UNION ALL SELECT 'quality', true FROM c UNION ALL SELECT 'all', dates AND place FROM c""",
)
def a12(spark, folder):
    return quality.validation(fx.detections(spark, folder), CONFIGURED_REGION, "1995-01-01", "2001-12-31")


@query(
    "a12_validation_incomplete",
    fx.ctes("detections")
    + f""", c AS (SELECT {INSIDE_SQL} >= 80 AS place FROM detections)
    SELECT 'schema' AS "check", false AS passed FROM c UNION ALL SELECT 'dates', false FROM c UNION ALL SELECT 'place', place FROM c
    UNION ALL SELECT 'quality', true FROM c UNION ALL SELECT 'all', false FROM c""",
)
def a12_incomplete(spark, folder):
    """A feed without dates fails its checks instead of the job."""
    return quality.validation(fx.detections(spark, folder).drop("acq_date"), CONFIGURED_REGION, "1995-01-01", "2001-12-31")


@query(
    "a13_tile_counts",
    fx.ctes("anchors")
    + f""", {BOXES_SQL}, c AS (SELECT tile, count(*) AS n FROM anchors JOIN tile_boxes ON {IN_BOX} GROUP BY 1)
    SELECT tile, n, round(n * 1e2 / sum(n) OVER (), 6) AS pct FROM c""",
)
def a13(spark, folder):
    return rounded(quality.share(spatial.tile_memberships(fx.anchors(spark, folder)), "tile", "tile"))


@query(
    "a13_first_match_counts",
    fx.ctes("requests")
    + f""", {BOXES_SQL}, c AS (SELECT (SELECT arg_min(tile, ord) FROM tile_boxes WHERE {IN_BOX}) AS tile FROM requests)
    SELECT tile, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS pct FROM c GROUP BY 1""",
)
def a13_first(spark, folder):
    return rounded(quality.share(spatial.first_tile(fx.requests(spark, folder)), "tile", "tile"))


@query(
    "a14_region_breakdown",
    fx.ctes("requests")
    + f""", {BOXES_SQL} SELECT CASE WHEN lat > 30 THEN 'northern' ELSE 'southern' END AS half,
    CASE WHEN lon < 67 THEN 'west' WHEN lon > 783e-1 AND lon < 808e-1 THEN 'between tiles' WHEN lon > 851e-1 THEN 'east' ELSE 'elsewhere' END AS band,
    count(*) AS n, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon
    FROM requests WHERE NOT EXISTS (SELECT 1 FROM tile_boxes WHERE {IN_BOX}) GROUP BY 1, 2""",
)
def a14(spark, folder):
    return quality.region_breakdown(spatial.unmatched(fx.requests(spark, folder)))


@query(
    "a15_completeness",
    fx.ctes("gappy_matrix")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_valid, round(count({c}) * 1e2 / count(*), 6) AS valid_pct, min({c}) AS min, max({c}) AS max FROM gappy_matrix"
        for c in ("f1", "f2", "f3")
    ),
)
def a15(spark, folder):
    matrix = fx.gappy_matrix(spark, folder)
    return quality.completeness(matrix, ["f1", "f2", "f3"]).withColumn("valid_pct", F.round("valid_pct", 6))


@query(
    "a16_dataset_summary",
    fx.ctes("anchors")
    + """SELECT count(*) AS n, CAST(count(*) FILTER (is_fire) AS BIGINT) AS n_fire, round(count(*) FILTER (is_fire) * 1e2 / count(*), 6) AS fire_pct,
    min(date) AS first_day, max(date) AS last_day, string_agg(DISTINCT CAST(year(date) AS VARCHAR), ',' ORDER BY CAST(year(date) AS VARCHAR)) AS years,
    round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM anchors""",
)
def a16(spark, folder):
    return rounded(quality.dataset_summary(fx.anchors(spark, folder)))


@query(
    "a17_selection_rates",
    f"WITH {NAMES_SQL}"
    + """, c AS (SELECT CASE WHEN contains(name, 'prec') THEN 'Precipitation' WHEN contains(name, 'lst') THEN 'Temperature'
    WHEN contains(name, 'ndvi') THEN 'Vegetation (NDVI)' WHEN contains(name, 'evi') THEN 'Vegetation (EVI)' WHEN contains(name, 'ndwi') THEN 'Moisture (NDWI)'
    WHEN name IN ('elevation', 'slope', 'aspect') THEN 'Terrain' ELSE 'Other' END AS category, length(name) % 2 = 0 AS selected FROM names)
    SELECT category, count(*) AS total, CAST(count(*) FILTER (selected) AS BIGINT) AS selected, CAST(count(*) FILTER (NOT selected) AS BIGINT) AS dropped,
    round(count(*) FILTER (selected) * 1e2 / count(*), 6) AS selected_pct FROM c GROUP BY 1""",
)
def a17(spark, folder):
    features = feature_names(spark, folder).select(F.col("name").alias("feature"), (F.length("name") % 2 == 0).alias("selected"))
    return rounded(quality.selection_rates(features))


@query("a19_class_distribution", fx.ctes("anchors") + "SELECT is_fire, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS pct FROM anchors GROUP BY 1")
def a19(spark, folder):
    return rounded(quality.share(fx.anchors(spark, folder), "is_fire", "is_fire"))


@query(
    "a19_month_distribution",
    fx.ctes("fires") + "SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS pct FROM fires GROUP BY 1",
)
def a19_month(spark, folder):
    return rounded(quality.share(fx.fires(spark, folder), F.month("date"), "month"))


# ---- cleaning ----

MEDIAN_SQL = ", m AS (SELECT median(f1) AS m1, median(f2) AS m2 FROM gappy_matrix)"


@query("c1_median_impute", fx.ctes("gappy_matrix") + MEDIAN_SQL + "SELECT pid, coalesce(f1, m1) AS f1, coalesce(f2, m2) AS f2, f3 FROM gappy_matrix, m")
def c1(spark, folder):
    return clean.impute_medians(fx.gappy_matrix(spark, folder), ["f1", "f2", "f3"]).select("pid", "f1", "f2", "f3")


@query(
    "c1_median_impute_train_only",
    fx.ctes("gappy_matrix")
    + """, m AS (SELECT median(f1) AS m1, median(f2) AS m2 FROM gappy_matrix WHERE date < DATE '2000-01-01')
    SELECT pid, coalesce(f1, m1) AS f1, coalesce(f2, m2) AS f2 FROM gappy_matrix, m""",
)
def c1_train(spark, folder):
    matrix = fx.gappy_matrix(spark, folder)
    train = matrix.where(F.col("date") < F.lit("2000-01-01").cast("date"))
    return clean.impute_medians(matrix, ["f1", "f2"], basis=train).select("pid", "f1", "f2")


@query("c2_zero_fill", fx.ctes("gappy_matrix") + "SELECT pid, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3 FROM gappy_matrix")
def c2(spark, folder):
    return clean.zero_fill(fx.gappy_matrix(spark, folder), ["f1", "f2", "f3"]).select("pid", "f1", "f2", "f3")


@query("c3_infinite_to_zero", fx.ctes("gappy_matrix") + "SELECT pid, CASE WHEN isinf(f2) THEN 0 ELSE f2 END AS f2 FROM gappy_matrix")
def c3(spark, folder):
    return clean.infinite_to_zero(fx.gappy_matrix(spark, folder), ["f2"]).select("pid", "f2")


@query("c4_resolve_target", fx.ctes("gappy_matrix") + "SELECT pid, CAST(is_fire AS INTEGER) AS target FROM gappy_matrix")
def c4(spark, folder):
    return clean.resolve_target(fx.gappy_matrix(spark, folder)).select("pid", "target")


@query("c5_feature_columns", fx.ctes("gappy_matrix") + "SELECT pid, f1, f2, f3 FROM gappy_matrix")
def c5(spark, folder):
    matrix = fx.gappy_matrix(spark, folder)
    return matrix.select(*clean.feature_columns(matrix))


@query(
    "c6_scoring_clean",
    fx.ctes("gappy_matrix") + "SELECT pid, coalesce(f1, 0) AS f1, CASE WHEN isinf(f2) THEN 0 ELSE coalesce(f2, 0) END AS f2, coalesce(f3, 0) AS f3 FROM gappy_matrix",
)
def c6(spark, folder):
    return clean.clean_for_scoring(fx.gappy_matrix(spark, folder), ["f1", "f2", "f3"]).select("pid", "f1", "f2", "f3")


@query(
    "c8_curve_clean",
    fx.ctes("gappy_matrix") + "SELECT pid, CASE WHEN f2 IS NULL THEN 0 WHEN f2 = 'inf'::DOUBLE THEN 1 WHEN f2 = '-inf'::DOUBLE THEN 0 ELSE f2 END AS f2 FROM gappy_matrix",
)
def c8(spark, folder):
    return fx.gappy_matrix(spark, folder).select("pid", clean.clean_curve(F.col("f2")).alias("f2"))


SPLIT_SQL = ", s AS (SELECT quantile_cont(epoch_us(CAST(date AS TIMESTAMP)), 8e-1) AS cut FROM scores)"


@query(
    "t8_temporal_split",
    fx.ctes("scores") + SPLIT_SQL + "SELECT pid, date, epoch_us(CAST(date AS TIMESTAMP)) < cut AS in_train FROM scores, s",
)
def t8(spark, folder):
    from cinderspark.operators.splits import temporal_split

    return temporal_split(fx.scores(spark, folder)).select("pid", "date", "in_train")


@query(
    "t8_split_report",
    fx.ctes("scores")
    + SPLIT_SQL
    + """SELECT in_train, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS pct, min(date) AS first_day, max(date) AS last_day
    FROM (SELECT date, epoch_us(CAST(date AS TIMESTAMP)) < cut AS in_train FROM scores, s) GROUP BY 1""",
)
def t8_report(spark, folder):
    from cinderspark.operators.splits import split_report, temporal_split

    return rounded(split_report(temporal_split(fx.scores(spark, folder))))


# ---- evaluation ----

COUNT_SQL = "count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn"
METRIC_SQL = """tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
SPLIT_PROBS_SQL = """, sp AS (SELECT p.pid, p.p, p.y, p.yhat, CASE WHEN epoch_us(CAST(date AS TIMESTAMP)) < cut THEN 'train' ELSE 'test' END AS side
  FROM probabilities p JOIN scores USING (pid), s)"""
AUC_SQL = """SELECT side, round(sum(neg * (tps - pos / 2)) / (max(all_pos) * max(all_neg)), 6) AS auc FROM (
  SELECT side, pos, neg, sum(pos) OVER (PARTITION BY side ORDER BY p DESC) AS tps, sum(pos) OVER (PARTITION BY side) AS all_pos, sum(neg) OVER (PARTITION BY side) AS all_neg
  FROM (SELECT side, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sp GROUP BY 1, 2)) GROUP BY 1"""


def split_probabilities(spark, folder):
    from cinderspark.operators.splits import temporal_split

    sides = temporal_split(fx.scores(spark, folder)).select("pid", F.when(F.col("in_train"), "train").otherwise("test").alias("side"))
    return fx.probabilities(spark, folder).join(sides, "pid")


@query(
    "e1_metrics",
    fx.ctes("probabilities") + SPLIT_SQL + SPLIT_PROBS_SQL + f"SELECT side, {METRIC_SQL}, auc FROM (SELECT side, {COUNT_SQL} FROM sp GROUP BY 1) JOIN ({AUC_SQL}) USING (side)",
)
def e1(spark, folder):
    both = split_probabilities(spark, folder)
    metrics = evaluation.classification_metrics(both, ["side"])
    train, test = (
        evaluation.roc_auc(both.where(F.col("side") == side), "p", "y").withColumn("side", F.lit(side)) for side in ("train", "test")
    )
    return rounded(metrics.join(train.unionByName(test), "side"))


@query(
    "e2_confusion_matrix",
    fx.ctes("probabilities")
    + """SELECT y, yhat, count(p) AS n, round(coalesce(count(p) / nullif(sum(count(p)) OVER (PARTITION BY y), 0), 0), 6) AS share FROM (
    VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(y, yhat) LEFT JOIN probabilities USING (y, yhat) GROUP BY 1, 2""",
)
def e2(spark, folder):
    return rounded(evaluation.confusion_matrix(fx.probabilities(spark, folder)))


@query(
    "e3_classification_report",
    fx.ctes("probabilities")
    + f""", c AS (SELECT {COUNT_SQL} FROM probabilities), r AS (
    SELECT '0' AS label, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s FROM c
    UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), tp + fn FROM c)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM r
    UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM r""",
)
def e3(spark, folder):
    return rounded(evaluation.classification_report(fx.probabilities(spark, folder)))


CURVE_SQL = """, c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tps, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fps,
  pos, neg, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scores GROUP BY 1))"""


@query(
    "e4_roc_curve",
    fx.ctes("scores") + CURVE_SQL + "SELECT round(fps / all_neg, 6) AS fpr, round(tps / all_pos, 6) AS tpr, score AS threshold FROM c UNION ALL SELECT 0, 0, 'inf'::DOUBLE",
)
def e4(spark, folder):
    return rounded(evaluation.roc_curve(fx.scores(spark, folder)))


@query("e4_roc_auc", fx.ctes("scores") + CURVE_SQL + "SELECT round(sum(neg * (tps - pos / 2)) / (max(all_pos) * max(all_neg)), 6) AS auc FROM c")
def e4_auc(spark, folder):
    return rounded(evaluation.roc_auc(fx.scores(spark, folder)))


@query(
    "e5_precision_recall_curve",
    fx.ctes("scores") + CURVE_SQL + "SELECT round(tps / (tps + fps), 6) AS precision, round(tps / all_pos, 6) AS recall, score AS threshold FROM c UNION ALL SELECT 1, 0, NULL",
)
def e5(spark, folder):
    return rounded(evaluation.precision_recall_curve(fx.scores(spark, folder)))


@query("e5_average_precision", fx.ctes("scores") + CURVE_SQL + "SELECT round(sum(pos / all_pos * (tps / (tps + fps))), 6) AS average_precision FROM c")
def e5_ap(spark, folder):
    return rounded(evaluation.average_precision(fx.scores(spark, folder)))


def _gap_sql() -> str:
    names = ("accuracy", "precision", "recall", "f1")
    m = f", m AS (SELECT side, {METRIC_SQL} FROM (SELECT side, {COUNT_SQL} FROM sp GROUP BY 1))"
    m = m.replace("round(", "(").replace(", 6)", ")")
    parts = [
        f"SELECT '{c}' AS metric, round(a.{c}, 6) AS train, round(b.{c}, 6) AS test, round(a.{c} - b.{c}, 6) AS gap, a.{c} - b.{c} > 5e-2 AS overfit FROM m a, m b WHERE a.side = 'train' AND b.side = 'test'"
        for c in names
    ]
    return fx.ctes("probabilities") + SPLIT_SQL + SPLIT_PROBS_SQL + m + " UNION ALL ".join(parts)


@query("e6_train_test_gap", _gap_sql())
def e6(spark, folder):
    both = split_probabilities(spark, folder)
    train, test = (
        evaluation.metrics_long(evaluation.classification_metrics(both.where(F.col("side") == side))) for side in ("train", "test")
    )
    return rounded(evaluation.train_test_gap(train, test))


@query(
    "e7_importance_ranking",
    f"WITH {NAMES_SQL}, f AS (SELECT name AS feature, sum(length(name) * p_size) AS importance FROM names, part GROUP BY 1) SELECT feature, CAST(importance AS BIGINT) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM f",
)
def e7(spark, folder):
    total = fx.table(spark, folder, "part").agg(F.sum("p_size").alias("size"))
    # One row of totals.
    scored = feature_names(spark, folder).join(F.broadcast(total))
    importance = scored.select(F.col("name").alias("feature"), (F.length("name") * F.col("size")).alias("importance"))
    return evaluation.ranked(importance, "importance").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "w1_top_k",
    fx.ctes("fires") + "SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) AS rank FROM (SELECT cell, count(*) AS n FROM fires GROUP BY 1) QUALIFY rank <= 10",
)
def w1(spark, folder):
    counts = fx.fires(spark, folder).groupBy("cell").agg(F.count("*").alias("n"))
    return evaluation.ranked(counts, "n", "cell", k=10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "e8_implied_confusion",
    fx.ctes("probabilities") + SPLIT_SQL + SPLIT_PROBS_SQL
    + f""", m AS (SELECT side, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM (SELECT side, {COUNT_SQL} FROM sp GROUP BY 1)),
    t AS (SELECT side, pr, CAST(floor(re * 500) AS BIGINT) AS tp FROM m), u AS (SELECT side, tp, CASE WHEN pr > 0 THEN CAST(trunc(tp / pr - tp) AS BIGINT) ELSE 0 END AS fp FROM t)
    SELECT side, tp, 500 - tp AS fn, fp, 500 - fp AS tn FROM u""",
)
def e8(spark, folder):
    metrics = evaluation.classification_metrics(split_probabilities(spark, folder), ["side"])
    return evaluation.implied_confusion(metrics).select("side", "tp", "fn", "fp", "tn")


@query(
    "e9_result_summary",
    fx.ctes("probabilities")
    + f"SELECT {METRIC_SQL}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM (SELECT {COUNT_SQL} FROM probabilities)",
)
def e9(spark, folder):
    from cinderspark.sources.sinks import result_summary

    record = result_summary(fx.probabilities(spark, folder), "random_forest", ["score"])
    cell = {name: F.col("confusion")[name].alias(name) for name in ("tp", "fp", "fn", "tn")}
    return rounded(record.select("metrics.*", *cell.values()))
