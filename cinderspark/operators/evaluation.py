"""Evaluation of scores and predictions.

Curves group by score first; running counts over the distinct scores are global sums that never sit in
one task (``running_totals``). Columns: y and yhat are 0/1, p is a score.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.operators.skew import default_buckets, range_splits, running_totals, with_bucket


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _counts(y: str, yhat: str) -> dict[str, Column]:
    t, h = F.col(y), F.col(yhat)
    return {
        "tp": _count((t == 1) & (h == 1)),
        "fp": _count((t == 0) & (h == 1)),
        "fn": _count((t == 1) & (h == 0)),
        "tn": _count((t == 0) & (h == 0)),
    }


def classification_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """n, accuracy, precision, recall and F1, per ``by``."""
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    counted = df.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in _counts(y, yhat).items()])
    n = c["tp"] + c["fp"] + c["fn"] + c["tn"]
    return counted.select(
        *(by or []),
        n.alias("n"),
        _ratio(c["tp"] + c["tn"], n).alias("accuracy"),
        _ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"),
        _ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"),
        _ratio(c["tp"] * 2, c["tp"] * 2 + c["fp"] + c["fn"]).alias("f1"),
    )


def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(y, yhat, n, share of the y row); all four cells are there, an empty row has share 0."""
    c = _counts(y, yhat)
    cells = [F.struct(F.lit(t).alias("y"), F.lit(h).alias("yhat"), F.col(k).alias("n")) for t, h, k in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]]
    long = df.agg(*[v.alias(k) for k, v in c.items()]).select(F.inline(F.array(*cells)))
    return long.withColumn("share", _ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y"))))


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Rows 0, 1, macro and weighted with precision, recall, F1 and support."""
    counted = df.agg(*[v.alias(k) for k, v in _counts(y, yhat).items()])
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}

    def entry(name: str, hit: Column, claimed: Column, actual: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            _ratio(hit, claimed).alias("precision"),
            _ratio(hit, actual).alias("recall"),
            _ratio(hit * 2, claimed + actual).alias("f1"),
            actual.alias("support"),
        )

    classes = F.array(
        entry("0", c["tn"], c["tn"] + c["fn"], c["tn"] + c["fp"]),
        entry("1", c["tp"], c["tp"] + c["fp"], c["tp"] + c["fn"]),
    )
    both = counted.select(F.inline(classes))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = both.agg(*[F.avg(n).alias(n) for n in names], total.alias("support"))
    weighted = both.agg(*[(F.sum(F.col(n) * F.col("support")) / total).alias(n) for n in names], total.alias("support"))
    return both.unionByName(macro.withColumn("label", F.lit("macro"))).unionByName(weighted.withColumn("label", F.lit("weighted")))


def score_counts(df: DataFrame, score: str, y: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum((1 - F.col(y)).cast("bigint")).alias("neg")
    )


def _cumulative(df: DataFrame, score: str, y: str) -> DataFrame:
    """(score, tps, fps, all_pos, all_neg): rows with a score at least as high, per distinct score."""
    splits = range_splits(df.select((-F.col(score).cast("double")).alias("_down")), "_down", default_buckets(df))
    counts = score_counts(df, score, y).withColumn("_down", -F.col("score"))
    running = running_totals(counts, "_down", {"tps": "pos", "fps": "neg"}, splits=splits)
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # One row of totals.
    return running.join(F.broadcast(totals)).drop("_down")


def roc_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, and the starting point (0, 0, +Inf)."""
    points = _cumulative(df, score, y).select(
        _ratio(F.col("fps"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("tps"), F.col("all_pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    start = df.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.unionByName(start)


def roc_auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row (auc): trapezoids between neighbouring distinct scores.

    A distinct score adds neg * (positives above it + pos / 2), so no neighbour row is needed.
    """
    part = F.col("neg") * (F.col("tps") - F.col("pos") / 2)
    return _cumulative(df, score, y).agg(_ratio(F.sum(part), F.max("all_pos") * F.max("all_neg")).alias("auc"))


def precision_recall_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(precision, recall, threshold) per distinct score, and the end point (1, 0, NULL)."""
    points = _cumulative(df, score, y).select(
        _ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        _ratio(F.col("tps"), F.col("all_pos")).alias("recall"),
        F.col("score").alias("threshold"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(end)


def average_precision(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row: sum over scores of the recall gained times the precision there."""
    gained = _ratio(F.col("pos"), F.col("all_pos")) * _ratio(F.col("tps"), F.col("tps") + F.col("fps"))
    return _cumulative(df, score, y).agg(F.sum(gained).alias("average_precision"))


def train_test_gap(train: DataFrame, test: DataFrame, limit: float = 0.05) -> DataFrame:
    """(metric, train, test, gap, overfit) out of two (metric, value) tables."""
    joined = train.select("metric", F.col("value").alias("train")).join(test.select("metric", F.col("value").alias("test")), "metric")
    return joined.withColumn("gap", F.col("train") - F.col("test")).withColumn("overfit", F.col("gap") > limit)


def metrics_long(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "n"]
    return metrics.select(*names).unpivot([], names, "metric", "value")


def implied_confusion(metrics: DataFrame, positives: int = 500, negatives: int = 500) -> DataFrame:
    """Confusion counts that precision and recall imply on a given number of positives and negatives."""
    tp = F.floor(F.col("recall") * positives).cast("bigint")
    claimed = F.when(F.col("precision") > 0, F.col("tp") / F.col("precision") - F.col("tp")).otherwise(0.0)
    return (
        metrics.withColumn("tp", tp)
        .withColumn("fn", F.lit(positives) - F.col("tp"))
        .withColumn("fp", claimed.cast("bigint"))
        .withColumn("tn", F.lit(negatives) - F.col("fp"))
    )


def ranked(scores: DataFrame, score: str, name: str = "feature", k: int | None = None) -> DataFrame:
    """Rows of a small score table (one per feature or model) with their rank; the first k of a table of any size."""
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(score), name))
    first = scores if k is None else scores.orderBy(F.desc(score), name).limit(k)
    return first.withColumn("rank", place)


def score_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Rows with the number of their about equally filled value range."""
    return with_bucket(df, column, range_splits(df, column, buckets))
