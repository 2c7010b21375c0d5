"""Selection, training, scoring and streaming on small tables."""

from datetime import date, timedelta
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from cinderspark.operators import clean, selection, training
from cinderspark.params import DEFAULT_SELECTION, FEATURES
from cinderspark.plans import fixtures as fx
from cinderspark.plans import models
from cinderspark.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """The label follows a and b; c and d are noise."""
    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 4))
    y = (data[:, 0] + data[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(int)
    return spark.createDataFrame(
        [(i, *map(float, data[i]), int(y[i])) for i in range(400)], "pid long, a double, b double, c double, d double, target int"
    )


def test_elimination_keeps_the_informative(rows):
    p = selection.Selection(k=4, repeats=1, folds=2, trees=10, max_depth=5)
    found = selection.recursive_elimination(rows, ["a", "b", "c", "d"], "target", p)
    assert {"a", "b"} <= set(found["selected"]) and set(found["accuracy_by_size"]) == {1, 2, 3, 4}
    assert found["best_accuracy"] == max(found["accuracy_by_size"].values()) > 0.8
    assert set(found["importances"]) == set(found["selected"])


def test_vote_and_fallback(spark, rows):
    p = selection.Selection(k=2, repeats=2, folds=2, trees=5, max_depth=4)
    assert set(selection.select_features(rows, ["a", "b", "c", "d"], "target", p)) <= {"a", "b"}
    assert selection.select_features(rows.drop("a"), ["a", "b"], "target", p) == ["a", "b"]


def test_projection_errors(rows):
    with pytest.raises(ValueError):
        selection.project(rows, None, ["pid"])
    with pytest.raises(ValueError):
        selection.project(rows, ["zz"], ["pid"])
    with pytest.raises(ValueError):
        clean.resolve_target(rows.drop("target"))


def test_scaler_handles_constants(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, None), (3, 5.0, 3.0)], "pid long, k double, v double")
    scaler = training.fit_scaler(df, ["k", "v"])
    assert {r["feature"]: r["std"] for r in scaler.collect()} == {"k": 1.0, "v": 1.0}
    got = [tuple(r) for r in training.apply_scaler(df, scaler, ["k", "v"]).orderBy("pid").select("k", "v").collect()]
    assert got == [(0.0, -1.0), (0.0, 0.0), (0.0, 1.0)]


def test_search_and_leaderboard(spark, rows):
    found = training.search(rows, ["a", "b"], s=training.Search(trees=5, max_depth=4, max_iter=10))
    assert sum(w for _, _, w in found.members) == pytest.approx(1.0) and len(found.members) <= 3
    board = training.leaderboard(spark, found)
    assert board.count() == len(found.fits) >= 4
    scored = found.predict(rows, label="target")
    accuracy = scored.agg(F.avg((F.col("y") == F.col("yhat")).cast("int"))).first()[0]
    assert accuracy > 0.85
    statistics = training.ensemble_statistics(board).first()
    assert statistics["total_weight"] == pytest.approx(1.0)


def test_metrics_score_each_row_once(spark, rows):
    model = training.random_forest(trees=3, max_depth=3).fit(training.with_vector(rows, ["a", "b"], "target"))
    scored = spark.sparkContext.accumulator(0)

    def count(a):
        scored.add(1)
        return a

    seen = rows.withColumn("a", F.udf(count, "double")("a"))
    found = training.evaluate(model, training.with_vector(seen, ["a", "b"], "target"))
    assert scored.value == 400 and found["auc"] > 0.9
    assert model.getOrDefault("cacheNodeIds")


def test_search_scores_the_holdout_once_per_algorithm(spark, rows, monkeypatch):
    scored, heard = spark.sparkContext.accumulator(0), training.predictions

    def counted(p):
        scored.add(1)
        return p

    def predictions(*args):
        made = heard(*args)
        return made.withColumn("p", F.udf(counted, "double")("p"))

    monkeypatch.setattr(training, "predictions", predictions)
    found = training.search(rows, ["a", "b"], s=training.Search(trees=2, max_depth=2, max_iter=5))
    assert 0 < scored.value <= 85 * len(found.fits)


def test_search_fits_once_where_there_is_nothing_to_choose(rows, monkeypatch):
    fitted = []

    class Counted(NaiveBayes):
        def _fit(self, df):
            fitted.append(df.count())
            return super()._fit(df)

    space = [("naive_bayes", Counted(labelCol="target", modelType="gaussian"), [{}])]
    monkeypatch.setattr(training, "search_space", lambda *args: space)
    found = training.search(rows, ["a", "b"], s=training.Search(steps=2))
    assert len(fitted) == 1 and fitted[0] < 400 and [f[0] for f in found.fits] == ["naive_bayes"]
    with pytest.warns(UserWarning, match="naive_bayes left out"):
        found = training.search(rows.withColumn("target", F.lit(0)), ["a", "b"], s=training.Search(steps=2))
    assert found.fits == []


def test_scaled_training_rows_are_written(spark):
    data = [(i, date(2020, 1, 1) + timedelta(i), float(i), i % 2) for i in range(100)]
    read = spark.sparkContext.accumulator(0)

    def count(a):
        read.add(1)
        return a

    dated = spark.createDataFrame(data, "pid long, date date, a double, target int").withColumn("a", F.udf(count, "double")("a"))
    train, test, _ = models.scaled_sides(dated, ["a"])
    before = read.value
    assert len(train.select("features").collect()) == 80 and read.value == before
    assert test.count() == 20


def test_spec_falls_back(spark, tmp_path):
    assert training.resolve_spec(spark, [str(tmp_path / "nothing")]) == DEFAULT_SELECTION
    selection.save_selection(spark, ["b", "a"], str(tmp_path / "spec"))
    assert training.resolve_spec(spark, [str(tmp_path / "nothing"), str(tmp_path / "spec")]) == ["b", "a"]


def test_saved_model_predicts_the_same(spark):
    first, second = (QUERIES[n](spark, FOLDER).toPandas().sort_values("pid").reset_index(drop=True) for n in ("m13_predict", "m14_save_load_model"))
    assert first.p.between(0, 1).all()
    np.testing.assert_allclose(first.p, second.p)


def test_batch_and_stream_score_alike(spark):
    batch, stream = (QUERIES[n](spark, FOLDER).toPandas().sort_values("pid").reset_index(drop=True) for n in ("q1_score_requests", "q2_score_request_stream"))
    n = fx.requests(spark, FOLDER).count()
    assert len(batch) == len(stream) == n
    assert batch.error.fillna("").tolist() == stream.error.fillna("").tolist()
    np.testing.assert_allclose(batch.probability, stream.probability)
    good = batch[batch.error.isna()]
    assert good.probability.between(0, 1).all() and (good.confidence - (good.probability - 0.5).abs() * 2).abs().max() < 1e-12
    assert set(batch.error.dropna()) == {"date in the future", "invalid date", "outside the region"}


def test_matrix_shape(spark):
    made = models.full_matrix(spark, FOLDER)
    assert [c for c in made.columns if c in FEATURES] == FEATURES and len(FEATURES) == 24
    assert clean.feature_columns(made.select("lat", "lon", "date", *FEATURES, "is_fire", "target")) == FEATURES


FITS = {
    "m3_recursive_elimination": (selection, "recursive_elimination"),
    "m4_multi_stage_selection": (selection, "vote"),
    "m6_evaluate_selection": (selection, "evaluate_selection"),
    "m10_model_search": (training, "search"),
    "m12_leaderboard": (training, "search"),
    "m11_cross_validated_accuracy": (training, "cross_validated_forest"),
    **dict.fromkeys(
        ["m9_random_forest", "e7_model_importances", "m13_predict", "m14_save_load_model", "q1_score_requests", "q2_score_request_stream"],
        (training, "random_forest"),
    ),
}


@pytest.mark.parametrize("name", FITS)
def test_registered_queries_use_all_features_and_defaults(spark, monkeypatch, name):
    class Reached(Exception):
        pass

    def stop(*args, **named):
        raise Reached(args, named)

    monkeypatch.setattr(models, "training_rows", MagicMock())
    monkeypatch.setattr(models, "scaled_sides", lambda *_: (MagicMock(), MagicMock(), MagicMock()))
    monkeypatch.setattr(models.splits, "temporal_split", MagicMock())
    monkeypatch.setattr(models.information, "mutual_information", MagicMock())
    ranked = [{"feature": f} for f in FEATURES[5:] + FEATURES[:5]]
    monkeypatch.setattr(models.information, "top_features", lambda _, k: MagicMock(collect=lambda: ranked if k == 12 else None))
    monkeypatch.setattr(*FITS[name], stop)
    with pytest.raises(Reached) as reached:
        QUERIES[name](spark, FOLDER)
    args, named = reached.value.args
    if FITS[name][1] == "random_forest":
        assert (args, named) == ((), {})
    elif name == "m3_recursive_elimination":
        assert args[1] == FEATURES[5:] + FEATURES[:5] and args[2:] == ("target", selection.Selection()) and not named
    else:
        assert args[1] == FEATURES and named.get("s", training.Search()) == training.Search()
        assert [a for a in args if isinstance(a, selection.Selection)] == [selection.Selection()] * (FITS[name][0] is selection)
