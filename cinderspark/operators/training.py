"""Scaling, model fits, model search, ensembles, prediction."""

import warnings
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException, SparkRuntimeException
from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.operators import forests
from cinderspark.operators.evaluation import classification_metrics, roc_auc
from cinderspark.operators.sampling import stratified_folds
from cinderspark.params import DEFAULT_SELECTION
from cinderspark.session import cut_lineage, shared_folder

# Algorithms that a search fits at a time: each is a chain of small jobs, which leave cores idle.
SEARCHED_AT_ONCE = 4


def fit_scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where it is 0; one pass."""
    parts = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in features
    ]
    long = train.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))
    return long.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Standardised features; NULL, NaN and infinities become 0."""
    # One row per feature.
    rows = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}

    def scaled(c: str) -> Column:
        mean, std = rows[c]
        z = (F.col(c) - F.lit(mean)) / F.lit(std)
        return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(z)

    return df.withColumns({c: scaled(c) for c in features})


def with_vector(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return out if label is None else out.withColumn(label, F.col(label).cast("double"))


def random_forest(label: str = "target", trees: int = 200, max_depth: int = 20, min_leaf: int = 2, seed: int = 42) -> RandomForestClassifier:
    """Bagged trees as the stand-in for a model search. Rows keep the node they have reached, so that a level does not
    walk down from the root again."""
    return RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=128, seed=seed, cacheNodeIds=True
    )


def probability_of(scored: DataFrame) -> Column:
    """P(fire) of any binary classifier; a margin is squashed."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))[1]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array(F.col("rawPrediction"))[1]))


def predictions(scored: DataFrame, label: str | None = "target", keep: list[str] | None = None) -> DataFrame:
    """(keep..., p, yhat[, y]) of a scored table."""
    columns = [*(keep or []), probability_of(scored).alias("p"), F.col("prediction").cast("int").alias("yhat")]
    return scored.select(*columns) if label is None else scored.select(*columns, F.col(label).cast("int").alias("y"))


def cross_validated_accuracy(df: DataFrame, estimator, label: str = "target", folds: int = 5, pid: str = "pid", seed: int = 42) -> tuple[float, float]:
    """Mean and population deviation of the accuracy over stratified folds."""
    dealt = stratified_folds(df, label, folds, pid, seed)
    tuner = CrossValidator(
        estimator=estimator, estimatorParamMaps=[{}], numFolds=folds, foldCol="fold", parallelism=2,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
    )
    model = tuner.fit(dealt)
    return float(model.avgMetrics[0]), float(model.stdMetrics[0])


def cross_validated_forest(
    df: DataFrame, features: list[str], label: str = "target", folds: int = 5, pid: str = "pid", trees: int = 200, max_depth: int = 20, min_leaf: int = 2, seed: int = 42
) -> tuple[float, float]:
    """As ``cross_validated_accuracy`` for the forest of ``random_forest``, the forests of all folds grown together."""
    growth = forests.Growth(trees=trees, max_depth=max_depth, min_leaf=min_leaf, bins=128)
    scores = forests.cross_validated(df, features, label, folds, pid, seed, growth)
    return float(np.mean(scores)), float(np.std(scores))


def evaluate(model: Model, df: DataFrame, label: str = "target") -> dict[str, float]:
    """Accuracy, precision, recall, F1 and AUC. Rows are scored once, however many passes the metrics take."""
    scored = cut_lineage(predictions(model.transform(df), label))
    row = classification_metrics(scored).first()
    return {m: row[m] for m in ("accuracy", "precision", "recall", "f1")} | {"auc": roc_auc(scored, "p", "y").first()["auc"]}


@dataclass(frozen=True)
class Search:
    """Model search: share for fitting, models to keep, steps of the greedy average."""

    train_share: float = 0.8
    keep: int = 3
    steps: int = 5
    seed: int = 42
    trees: int = 100
    max_depth: int = 10
    max_iter: int = 50
    parallel_fits: int = 2


def search_space(n_features: int, label: str, s: Search) -> list[tuple[str, object, list]]:
    """(name, estimator, parameter grid) of each algorithm."""
    lr = LogisticRegression(labelCol=label, maxIter=s.max_iter)
    rf = RandomForestClassifier(labelCol=label, numTrees=s.trees, maxDepth=s.max_depth, seed=s.seed, cacheNodeIds=True)
    gbt = GBTClassifier(labelCol=label, maxIter=max(5, s.max_iter // 3), seed=s.seed)
    svc = LinearSVC(labelCol=label, maxIter=s.max_iter)
    mlp = MultilayerPerceptronClassifier(labelCol=label, layers=[n_features, 16, 2], maxIter=s.max_iter, seed=s.seed)
    nb = NaiveBayes(labelCol=label, modelType="gaussian")
    return [
        ("logistic_regression", lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01]).build()),
        ("random_forest", rf, ParamGridBuilder().addGrid(rf.minInstancesPerNode, [1, 5]).build()),
        ("gradient_boosting", gbt, ParamGridBuilder().addGrid(gbt.maxDepth, [3, 5]).build()),
        ("linear_svc", svc, ParamGridBuilder().addGrid(svc.regParam, [0.01]).build()),
        ("neural_network", mlp, ParamGridBuilder().addGrid(mlp.stepSize, [0.03]).build()),
        ("naive_bayes", nb, [{}]),
    ]


@dataclass
class Ensemble:
    """Weighted models: members are (name, model, weight)."""

    members: list[tuple[str, Model, float]]
    fits: list[tuple[str, str, float]] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, pid: str = "pid", label: str | None = None) -> DataFrame:
        """(pid, p, yhat[, y]): weighted mean of the members' probabilities, in one row pass."""
        scored = df if "features" in df.columns else with_vector(df, self.features)
        for i, (_, model, _) in enumerate(self.members):
            made = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
            scored = model.transform(scored.drop(*made))
            scored = scored.withColumn(f"_p{i}", probability_of(scored))
        p = sum((F.col(f"_p{i}") * F.lit(w) for i, (_, _, w) in enumerate(self.members)), F.lit(0.0))
        out = scored.select(pid, p.alias("p"), *([F.col(label).cast("int").alias("y")] if label else []))
        return out.withColumn("yhat", (F.col("p") >= 0.5).cast("int"))


def search(df: DataFrame, features: list[str], label: str = "target", pid: str = "pid", s: Search = Search()) -> Ensemble:
    """Try the algorithms on one holdout, some side by side, keep the best by AUC, and average them greedily.

    Each step of the greedy average adds, with repetition, the model that lifts the AUC of the mean
    probability most. If no algorithm can be fitted, a random forest is the whole ensemble.
    """
    from cinderspark.operators.sampling import stratified_split

    data = stratified_split(with_vector(df, features, label).select(pid, label, "features"), label, s.train_share, pid).persist()
    train, held = data.where("in_train"), data.where("NOT in_train")
    scorer = BinaryClassificationEvaluator(labelCol=label)
    # The folder of the checkpoints is set before threads write there.
    shared_folder(df.sparkSession)

    def tried(one: tuple) -> tuple[str, str, Model, float] | str:
        name, estimator, grid = one
        try:
            if len(grid) == 1:
                # Nothing to choose, so one fit is enough.
                best = estimator.fit(train, grid[0])
                if best.numClasses != 2:
                    return f"{name} left out: {best.numClasses} classes"
            else:
                tuner = TrainValidationSplit(
                    estimator=estimator, estimatorParamMaps=grid, evaluator=scorer, trainRatio=s.train_share, seed=s.seed,
                    parallelism=s.parallel_fits,
                )
                best = tuner.fit(train).bestModel
            scored = cut_lineage(predictions(best.transform(held), label))
            return name, type(best).__name__, best, roc_auc(scored, "p", "y").first()["auc"]
        except (IllegalArgumentException, SparkRuntimeException) as e:
            # An algorithm that refuses these data; anything else is raised.
            return f"{name} left out: {str(e).splitlines()[0]}"

    def side_by_side(work, items: list) -> list:
        with ThreadPoolExecutor(SEARCHED_AT_ONCE) as pool:
            return list(pool.map(inheritable_thread_target(df.sparkSession)(work), items))

    try:
        data.count()
        outcomes = side_by_side(tried, search_space(len(features), label, s))
        for reason in (o for o in outcomes if isinstance(o, str)):
            warnings.warn(reason, stacklevel=2)
        found = [o for o in outcomes if not isinstance(o, str)]
        if not found:
            return Ensemble([("random_forest", random_forest(label).fit(data), 1.0)], features=features)
        top = sorted(found, key=lambda f: -f[3])[: s.keep]
        joint = held
        for i, (_, _, model, _) in enumerate(top):
            made = [c for c in ("rawPrediction", "probability", "prediction") if c in joint.columns]
            joint = model.transform(joint.drop(*made))
            joint = joint.withColumn(f"_p{i}", probability_of(joint))
        joint = joint.select(F.col(label).cast("int").alias("y"), *[f"_p{i}" for i in range(len(top))]).persist()
        picked: list[int] = []
        for _ in range(s.steps):
            def lifted(i: int) -> float:
                mean = sum((F.col(f"_p{j}") for j in [*picked, i]), F.lit(0.0)) / len([*picked, i])
                return roc_auc(joint.select("y", mean.alias("p")), "p", "y").first()["auc"]

            # A mean of one model has the AUC that is known.
            aucs = side_by_side(lifted, list(range(len(top)))) if picked else [auc for *_, auc in top]
            picked.append(max(range(len(top)), key=aucs.__getitem__))
        joint.unpersist()
        weights = Counter(picked)
        members = [(top[i][0], top[i][2], n / s.steps) for i, n in sorted(weights.items(), key=lambda kv: -kv[1])]
        return Ensemble(members, [(name, kind, auc) for name, kind, _, auc in found], features)
    finally:
        data.unpersist()


def leaderboard(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """(rank, name, type, auc, weight) of every model tried."""
    weights = {name: w for name, _, w in ensemble.members}
    rows = [
        (i + 1, name, kind, auc, float(weights.get(name, 0.0)))
        for i, (name, kind, auc) in enumerate(sorted(ensemble.fits, key=lambda f: (-f[2], f[0])))
    ]
    return spark.createDataFrame(rows, "rank int, name string, type string, auc double, weight double")


def ensemble_statistics(board: DataFrame) -> DataFrame:
    """One row: models, total weight, weight of the heaviest, models per type."""
    used = board.where("weight > 0")
    types = used.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("model_types")
    )
    totals = used.agg(F.count(F.lit(1)).alias("total_models"), F.sum("weight").alias("total_weight"), F.max("weight").alias("top_weight"))
    # Two one-row tables.
    return totals.join(F.broadcast(types))


def save_model(model: PipelineModel | Model, scaler: DataFrame, features: list[str], results: dict[str, float], path: str) -> None:
    """Model, scaler table and a spec record under one folder."""
    spark = scaler.sparkSession
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    spec = spark.createDataFrame(
        [(features, len(features), type(model).__name__, {k: float(v) for k, v in results.items()})],
        "selected_features array<string>, num_features int, model_type string, training_results map<string,double>",
    )
    spec.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/spec")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, list[str]]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler"), load_spec(spark, f"{path}/spec")


def load_spec(spark: SparkSession, path: str) -> list[str]:
    return list(spark.read.schema("selected_features array<string>").json(path).first()["selected_features"])


def resolve_spec(spark: SparkSession, paths: list[str]) -> list[str]:
    """Features of the first saved spec that can be read; a fixed list if there is none."""
    for path in paths:
        try:
            return load_spec(spark, path)
        except AnalysisException:  # no such file
            continue
    return list(DEFAULT_SELECTION)


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if c not in df.columns]


def predict(df: DataFrame, model: PipelineModel | Model, scaler: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., p, yhat): select, scale, score."""
    missing = missing_features(df, features)
    if missing:
        raise ValueError(f"missing features: {missing}")
    scaled = with_vector(apply_scaler(df.select(*keep, *features), scaler, features), features)
    return predictions(model.transform(scaled), None, keep)
