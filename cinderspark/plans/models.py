"""Full matrix, feature selection, training and scoring over the test tables."""

from pyspark.sql import functions as F

from cinderspark.functions.values import temperature_k
from cinderspark.operators import bands as band_ops
from cinderspark.operators import chain, clean, evaluation, information, matrix, scoring, selection, splits, training
from cinderspark.operators.skew import lookup
from cinderspark.params import FEATURES
from cinderspark.plans import fixtures as fx
from cinderspark.plans.core import KEY, ON, rounded, stats_sql
from cinderspark.plans.files import scratch
from cinderspark.plans.registry import draw_sql, query, uniform_sql
from cinderspark.plans.reports import HORN_SQL, terrain_table
from cinderspark.session import cut_lineage


def observations(spark, folder) -> matrix.Observations:
    heat = fx.temperature_raw(spark, folder).select("cell", "day", temperature_k(F.col("raw")).alias("kelvin"))
    wide = band_ops.assemble(fx.daily_bands(spark, folder), KEY, "day", nodata=7)
    terrain = terrain_table(spark, folder).withColumnsRenamed({"row": "terrain_row", "col": "terrain_col"})
    return matrix.Observations(fx.rain(spark, folder), heat, band_ops.indices_per_day(wide), terrain)


def full_matrix(spark, folder):
    return matrix.feature_matrix(fx.anchors(spark, folder), observations(spark, folder))


# Features straight from their definitions: windows exploded to days, days joined to the cell tables.
FEATURE_SQL = (
    fx.ctes("windowed", "temperature", "daily_bands", "elevation")
    + HORN_SQL
    + f""", wide AS (SELECT cell, day, max(raw) FILTER (band = 'red' AND raw <> 7) / 1e4 AS red, max(raw) FILTER (band = 'nir' AND raw <> 7) / 1e4 AS nir,
      max(raw) FILTER (band = 'blue' AND raw <> 7) / 1e4 AS blue, max(raw) FILTER (band = 'swir1' AND raw <> 7) / 1e4 AS swir1 FROM daily_bands GROUP BY 1, 2 HAVING count(*) >= 4),
    vi AS (SELECT cell, day, (nir - red) / nullif(nir + red, 0) AS ndvi, 25e-1 * (nir - red) / nullif(nir + 6 * red - 75e-1 * blue + 1, 0) AS evi, (nir - swir1) / nullif(nir + swir1, 0) AS ndwi FROM wide),
    days AS (SELECT cell, date, dtw_start, CAST(unnest(generate_series(dtw_start, dtw_end, INTERVAL 1 DAY)) AS DATE) AS day FROM windows),
    dynamic AS (SELECT d.cell, d.date, {stats_sql("coalesce(r.mm, 0)", "prec", True)}, {stats_sql("t.kelvin", "lst")},
      {", ".join(stats_sql(f"CASE WHEN (d.day - d.dtw_start) % 3 = 0 THEN v.{i} END", i) for i in ("ndvi", "evi", "ndwi"))}
      FROM days d LEFT JOIN rain r ON d.cell = r.cell AND d.day = r.day LEFT JOIN temperature t ON d.cell = t.cell AND d.day = t.day
      LEFT JOIN vi v ON d.cell = v.cell AND d.day = v.day GROUP BY 1, 2),
    features AS (SELECT w.pid, w.lat, w.lon, w.date, w.is_fire, w.dtw_start, w.dtw_end, d.* EXCLUDE (cell, date), e.elevation, round(e.slope, 6) AS slope, round(e.aspect, 6) AS aspect
      FROM windowed w JOIN dynamic d USING (cell, date) LEFT JOIN terrain e ON w.terrain_row = e.row AND w.terrain_col = e.col)"""
)
NULLS_SQL = " + ".join(f"({c} IS NULL)::INTEGER" for c in FEATURES)
FEATURE_LIST = ", ".join(FEATURES)


@query("a6_feature_matrix", FEATURE_SQL + f"SELECT pid, round(lat, 6) AS lat, round(lon, 6) AS lon, date, {FEATURE_LIST}, CAST(is_fire AS INTEGER) AS target FROM features WHERE {NULLS_SQL} <= 12")
def a6(spark, folder):
    return rounded(full_matrix(spark, folder).select("pid", "lat", "lon", "date", *FEATURES, "target"))


@query("a6_feature_matrix_keep_all", FEATURE_SQL + f"SELECT pid, {FEATURE_LIST}, {NULLS_SQL} AS n_null FROM features")
def a6_keep_all(spark, folder):
    made = matrix.feature_matrix(fx.anchors(spark, folder), observations(spark, folder), max_null_share=None)
    return rounded(made.select("pid", *FEATURES, matrix.null_features().alias("n_null")))


@query("j5_feature_blocks", FEATURE_SQL + f"SELECT pid, {FEATURE_LIST} FROM features")
def j5(spark, folder):
    return rounded(matrix.extract_features(fx.anchors(spark, folder), observations(spark, folder)).select("pid", *FEATURES))


@query("j6_metadata_reattach", FEATURE_SQL + "SELECT pid, round(lat, 6) AS lat, round(lon, 6) AS lon, date, is_fire, dtw_start, dtw_end, prec_sum FROM features")
def j6(spark, folder):
    """Values come back keyed only by id and get their point columns again."""
    anchors = fx.anchors(spark, folder)
    made = matrix.extract_features(anchors, observations(spark, folder)).select("pid", "prec_sum", "dtw_start", "dtw_end")
    return rounded(anchors.select("pid", "lat", "lon", "date", "is_fire").join(made, "pid"))


BATCH_COLUMNS = [c for c in FEATURES if c.startswith(("lst", "ndvi", "evi", "ndwi"))]


@query(
    "a4_batch_features",
    FEATURE_SQL + f"SELECT pid, round(lat, 6) AS lat, round(lon, 6) AS lon, dtw_start, dtw_end, {', '.join(BATCH_COLUMNS)}, elevation, slope, aspect FROM features",
)
def a4(spark, folder):
    """Batch forms one after the other on points that bring their windows."""
    from cinderspark.operators import lookback, terrain, windowstats

    obs, points = observations(spark, folder), fx.anchors(spark, folder)
    given = lookback.window_per_key(points, obs.rain, KEY, "date", "day", "mm")
    heat = windowstats.temperature_statistics(given, obs.temperature, KEY)
    both = windowstats.vegetation_statistics(heat, obs.vegetation, KEY)
    added = lookup(points, both, ON)
    placed = terrain.sample_terrain(added, obs.terrain.withColumnsRenamed({"terrain_row": "row", "terrain_col": "col"}))
    return rounded(placed.select("pid", "lat", "lon", "dtw_start", "dtw_end", *BATCH_COLUMNS, "elevation", "slope", "aspect"))


LINE_FEATURES = ["quantity", "price", "discount", "tax"]


def _mi_sql() -> str:
    """The estimator by as-of joins on distinct values; values are whole, so half a step counts equal ones."""
    parts, blocks = [], []
    psi = lambda n: f"(ln({n} + 8e0) - 5e-1 / ({n} + 8e0) - 1 / (12 * power({n} + 8e0, 2)) + 1 / (120 * power({n} + 8e0, 4)) - 1 / (252 * power({n} + 8e0, 6)) - ({' + '.join(f'1 / ({n} + {i}e0)' for i in range(8))}))"
    for i, c in enumerate(LINE_FEATURES):
        noise = f"(sqrt(-2 * ln(({draw_sql(f'{42 + i}:u1')} + 1) / 281474976710656e0)) * cos({uniform_sql(f'{42 + i}:u2')} * 6283185307179586e-15))"
        gaps = ", ".join([f"abs(x - lag(x, {j}) OVER w)" for j in (1, 2, 3)] + [f"abs(x - lead(x, {j}) OVER w)" for j in (1, 2, 3)])
        blocks.append(f"""x{i} AS (SELECT pid, y, floor(({c} / s + {noise} * (1e-10 * greatest(1, round(m / s, 6)))) * power(2e0, 51 - ceil(log2(top / s + 1))) + 5e-1) AS x
          FROM labelled_lines, (SELECT round(stddev_pop({c}), 6) AS s, avg(abs({c})) AS m, max(abs({c})) AS top FROM labelled_lines)),
        r{i} AS (SELECT pid, y, x, list_sort(list_filter([{gaps}], lambda g: g IS NOT NULL))[3] AS r, count(*) OVER (PARTITION BY y) AS n FROM x{i} WINDOW w AS (PARTITION BY y ORDER BY x, pid)),
        c{i} AS (SELECT x AS v, sum(count(*)) OVER (ORDER BY x) AS c FROM x{i} GROUP BY 1),
        m{i} AS (SELECT p.pid, p.n, hi.c - coalesce(lo.c, 0) AS m FROM r{i} p ASOF JOIN c{i} hi ON p.x + CASE WHEN p.r = 0 THEN 5e-1 ELSE p.r END > hi.v ASOF LEFT JOIN c{i} lo ON p.x - CASE WHEN p.r = 0 THEN 5e-1 ELSE p.r END >= lo.v)""")
        parts.append(f"""SELECT {i} AS ordinal, '{c}' AS feature, round(greatest({psi("count(*)")} + {psi("3e0")} - avg({psi("n")}) - avg({psi("m")}), 0), 6) AS mi FROM m{i}""")
    return fx.ctes("labelled_lines") + ", " + ", ".join(blocks) + " UNION ALL ".join(parts)


@query("m1_mutual_information", _mi_sql())
def m1(spark, folder):
    return rounded(information.mutual_information(fx.labelled_lines(spark, folder), LINE_FEATURES, "y"))


BINNED_SQL = (
    fx.ctes("labelled_lines")
    + ", q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS q_{c}" for c in LINE_FEATURES)
    + " FROM labelled_lines), b AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS feature, y, len(list_filter(q_{c}, lambda e: {c} > e)) AS bin FROM labelled_lines, q" for i, c in enumerate(LINE_FEATURES)
    )
    + """), n AS (SELECT ordinal, feature, bin, y, count(*) AS n FROM b GROUP BY 1, 2, 3, 4),
    mi AS (SELECT ordinal, feature, sum(part) AS mi FROM (SELECT ordinal, feature, n / sum(n) OVER (PARTITION BY ordinal) *
      ln(n * sum(n) OVER (PARTITION BY ordinal) / (sum(n) OVER (PARTITION BY ordinal, bin) * sum(n) OVER (PARTITION BY ordinal, y))) AS part FROM n) GROUP BY 1, 2)"""
)


@query("m1_binned_mutual_information", BINNED_SQL + "SELECT ordinal, feature, round(mi, 9) AS mi FROM mi")
def m1_binned(spark, folder):
    return rounded(information.binned_mutual_information(fx.labelled_lines(spark, folder), LINE_FEATURES, "y"), 9)


@query("m2_top_k_features", BINNED_SQL + "SELECT ordinal, feature FROM mi ORDER BY mi DESC, ordinal LIMIT 2")
def m2(spark, folder):
    scores = information.binned_mutual_information(fx.labelled_lines(spark, folder), LINE_FEATURES, "y")
    return information.top_features(scores, 2).select("ordinal", "feature")


@query(
    "m4_majority_vote",
    """SELECT p_brand AS feature, count(DISTINCT p_size % 10) AS votes, count(DISTINCT p_size % 10) > 5 AS selected FROM part GROUP BY 1""",
)
def m4_vote(spark, folder):
    part = fx.table(spark, folder, "part")
    return selection.majority(part.select((F.col("p_size") % 10).alias("run"), F.col("p_brand").alias("feature")), 10)


SCALE_SQL = fx.ctes("scores") + ", t AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scores WHERE date < DATE '2000-01-01')"


@query("m8_scaler_fit", SCALE_SQL + "SELECT 'score' AS feature, round(m, 6) AS mean, round(s, 6) AS std FROM t")
def m8_fit(spark, folder):
    train = fx.scores(spark, folder).where(F.col("date") < F.lit("2000-01-01").cast("date"))
    return rounded(training.fit_scaler(train, ["score"]))


@query("m8_standard_scale", SCALE_SQL + "SELECT pid, round((score - m) / s, 6) AS score FROM scores, t")
def m8(spark, folder):
    rows = fx.scores(spark, folder)
    scaler = training.fit_scaler(rows.where(F.col("date") < F.lit("2000-01-01").cast("date")), ["score"])
    return rounded(training.apply_scaler(rows, scaler, ["score"]).select("pid", "score"))


def training_rows(spark, folder):
    """Cleaned matrix with a label its own features explain, written once and read back; medians are those of the
    training rows."""
    path = scratch(spark, "training")
    made = full_matrix(spark, folder)
    label = (F.coalesce("prec_mean", F.lit(0.0)) * 2 - F.coalesce("ndvi_mean", F.lit(0.0)) * 10 + F.col("pid") % 7 > 12).cast("int")
    made.withColumn("target", label).write.parquet(path)
    rows = spark.read.parquet(path)
    return clean.clean_for_training(rows, FEATURES, splits.temporal_split(rows).where("in_train"))


def scaled_sides(rows, features):
    """(train, test, scaler); the training side is written once, as a fit reads it many times."""
    dated = splits.temporal_split(rows)
    train, test = dated.where("in_train"), dated.where("NOT in_train")
    scaler = training.fit_scaler(train, features)
    prepare = lambda side: training.with_vector(training.apply_scaler(side, scaler, features), features, "target")
    return cut_lineage(prepare(train)), prepare(test), scaler


SELECTION = selection.Selection()


@query("m3_recursive_elimination")
def m3(spark, folder):
    """Elimination among the features that rank highest by mutual information."""
    rows = training_rows(spark, folder)
    scores = information.mutual_information(rows, FEATURES, "target", seed=SELECTION.seed)
    ranked = [r["feature"] for r in information.top_features(scores, SELECTION.k).collect()]
    found = selection.recursive_elimination(rows, ranked, "target", SELECTION)
    out = [(size, float(a), size == len(found["selected"])) for size, a in found["accuracy_by_size"].items()]
    return spark.createDataFrame(out, "n_features int, accuracy double, best boolean")


@query("m4_multi_stage_selection")
def m4(spark, folder):
    rows = training_rows(spark, folder)
    return selection.majority(selection.vote(rows, FEATURES, "target", SELECTION).where("stage = 'pick'"), SELECTION.repeats)


@query("m5_project_selected", FEATURE_SQL + "SELECT pid, prec_mean, ndvi_mean FROM features WHERE " + NULLS_SQL + " <= 12")
def m5(spark, folder):
    return rounded(selection.project(full_matrix(spark, folder), ["prec_mean", "ndvi_mean"], ["pid"]))


@query("m6_evaluate_selection")
def m6(spark, folder):
    rows = splits.temporal_split(training_rows(spark, folder))
    found = selection.evaluate_selection(rows.where("in_train"), FEATURES, "target", rows.where("NOT in_train"), SELECTION)
    out = [(k, float(v)) for k, v in found.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(out, "metric string, value double")


@query(
    "m7_save_load_selection",
    "SELECT unnest(list_sort(list(p_brand))) AS feature FROM (SELECT DISTINCT p_brand FROM part)",
)
def m7(spark, folder):
    # A selection is a list of names; the brands are few.
    names = [r[0] for r in fx.table(spark, folder, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    path = scratch(spark, "selection")
    selection.save_selection(spark, names, path)
    return spark.createDataFrame([(n,) for n in selection.load_selection(spark, path)], "feature string")


MODEL_FEATURES = FEATURES


@query("m9_random_forest")
def m9(spark, folder):
    train, test, _ = scaled_sides(training_rows(spark, folder), MODEL_FEATURES)
    model = training.random_forest().fit(train)
    out = [(side, k, float(v)) for side, rows in (("train", train), ("test", test)) for k, v in training.evaluate(model, rows).items()]
    return spark.createDataFrame(out, "side string, metric string, value double")


@query("e7_model_importances")
def e7_model(spark, folder):
    """Importances of a fitted forest, highest first; one row per feature."""
    train, _, _ = scaled_sides(training_rows(spark, folder), MODEL_FEATURES)
    found = training.random_forest().fit(train).featureImportances.toArray()
    scores = [(name, float(value)) for name, value in zip(MODEL_FEATURES, found, strict=True)]
    return evaluation.ranked(spark.createDataFrame(scores, "feature string, importance double"), "importance")


@query("m10_model_search")
def m10(spark, folder):
    train, test, _ = scaled_sides(training_rows(spark, folder), MODEL_FEATURES)
    found = training.search(train.drop("features"), MODEL_FEATURES)
    return evaluation.classification_metrics(found.predict(test, label="target"))


@query("m11_cross_validated_accuracy")
def m11(spark, folder):
    train, _, _ = scaled_sides(training_rows(spark, folder), MODEL_FEATURES)
    mean, std = training.cross_validated_forest(train, MODEL_FEATURES)
    return spark.createDataFrame([(mean, std)], "cv_accuracy_mean double, cv_accuracy_std double")


@query("m12_leaderboard")
def m12(spark, folder):
    train, _, _ = scaled_sides(training_rows(spark, folder), MODEL_FEATURES)
    return training.leaderboard(spark, training.search(train.drop("features"), MODEL_FEATURES))


def _fitted(spark, folder):
    rows = training_rows(spark, folder)
    train, _, scaler = scaled_sides(rows, MODEL_FEATURES)
    return rows, training.random_forest().fit(train), scaler


@query("m13_predict")
def m13(spark, folder):
    rows, model, scaler = _fitted(spark, folder)
    return training.predict(rows, model, scaler, MODEL_FEATURES, ["pid"])


@query("m14_save_load_model")
def m14(spark, folder):
    rows, model, scaler = _fitted(spark, folder)
    path = scratch(spark, "model")
    training.save_model(model, scaler, MODEL_FEATURES, {"test_auc": 0.0}, path)
    loaded, stored, features = training.load_model(spark, path)
    return training.predict(rows, loaded, stored, features, ["pid"])


def raw_rows(spark, folder):
    """The matrix with the label of ``training_rows`` and its gaps, written once and read back."""
    path = scratch(spark, "matrix")
    made = full_matrix(spark, folder)
    label = (F.coalesce("prec_mean", F.lit(0.0)) * 2 - F.coalesce("ndvi_mean", F.lit(0.0)) * 10 + F.col("pid") % 7 > 12).cast("int")
    made.select("pid", "lat", "lon", "date", *FEATURES, label.alias("target")).write.parquet(path)
    return spark.read.parquet(path)


@query("m16_train_chain")
def m16(spark, folder):
    """From the matrix to a measured model in one call, selection by vote included."""
    found = chain.train(raw_rows(spark, folder), p=SELECTION)
    return spark.createDataFrame([(k, float(v)) for k, v in found.results.items()], "metric string, value double")


@query("m17_evaluate_saved_model")
def m17(spark, folder):
    """Confusion of a saved model on the rows after the split."""
    rows, path = raw_rows(spark, folder), scratch(spark, "saved")
    chain.train(rows, p=None, path=path)
    return rounded(chain.evaluate_saved(rows, path).confusion)


@query(
    "m15_resolve_spec",
    FEATURE_SQL + "SELECT pid, ndvi_max, prec_mean, prec_max, prec_sum, elevation, ndvi_median, evi_max, ndvi_mean, evi_median FROM features WHERE " + NULLS_SQL + " <= 12",
)
def m15(spark, folder):
    features = training.resolve_spec(spark, [scratch(spark, "none")])
    return rounded(selection.project(full_matrix(spark, folder), features, ["pid"]))


@query("q1_score_requests")
def q1(spark, folder):
    _, model, scaler = _fitted(spark, folder)
    return scoring.score_requests(fx.requests(spark, folder), observations(spark, folder), model, scaler, MODEL_FEATURES)


@query("q2_score_request_stream")
def q2(spark, folder):
    from cinderspark.streaming.requests import read_requests, score_stream

    _, model, scaler = _fitted(spark, folder)
    wanted, obs = fx.requests(spark, folder), observations(spark, folder).written(scratch(spark, "observations"))
    source, output = scratch(spark, "requests"), scratch(spark, "scores")
    wanted.repartition(3).write.json(source)
    stream = read_requests(spark, source, wanted.schema)
    score = lambda batch: scoring.score_requests(batch, obs, model, scaler, MODEL_FEATURES)
    score_stream(stream, score, output, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(output).drop("batch")


@query(
    "m12_ensemble_statistics",
    """, w AS (SELECT p_brand, p_type, CASE WHEN sum(p_size) % 3 > 0 THEN sum(p_size) / 1e3 ELSE 0 END AS weight FROM part GROUP BY 1, 2),
    t AS (SELECT p_type, count(*) AS n FROM w WHERE weight > 0 GROUP BY 1)
    SELECT count(*) AS total_models, round(sum(weight), 6) AS total_weight, round(max(weight), 6) AS top_weight,
    (SELECT string_agg(p_type || '=' || n, ',' ORDER BY p_type) FROM t) AS model_types FROM w WHERE weight > 0""".replace(", w AS", "WITH w AS", 1),
)
def m12_statistics(spark, folder):
    size = F.sum("p_size")
    board = fx.table(spark, folder, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("type")).agg(
        F.when(size % 3 > 0, size / F.lit(1e3)).otherwise(0.0).alias("weight")
    )
    entries = F.transform(F.map_entries("model_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rounded(training.ensemble_statistics(board).withColumn("model_types", F.array_join(entries, ",")))
