"""Scoring of request tables."""

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderspark.functions.risk import LAST_DATA_DAY, confidence, request_error, risk_level
from cinderspark.operators.clean import clean_for_scoring, complete_columns
from cinderspark.operators.matrix import Observations, extract_features
from cinderspark.operators.training import predict
from cinderspark.params import FEATURES, REGION, Box


def score_requests(
    requests: DataFrame, obs: Observations, model: PipelineModel | Model, scaler: DataFrame, features: list[str],
    today: Column | None = None, box: Box = REGION, last_day: str = LAST_DATA_DAY,
) -> DataFrame:
    """(pid, lat, lon, date, probability, risk_level, confidence, features_used, error), a row per request.

    Requests bring their cell columns. Gaps in the features are zeros, as the medians of the training rows are not
    at hand. Refused ones keep their reason; there is no limit on how many come
    at once. Equal places and days share one look-back.
    """
    day = F.current_date() if today is None else today
    checked = requests.withColumn("error", request_error(F.col("lat"), F.col("lon"), F.col("date"), day, box, last_day))
    good = checked.where("error IS NULL").withColumn("day", F.to_date("date"))
    made = extract_features(good, obs, date="day")
    keep = ["pid", "lat", "lon", "date"]
    scored = predict(clean_for_scoring(complete_columns(made, FEATURES, keep), FEATURES), model, scaler, features, keep)
    answered = scored.select(
        *keep,
        F.col("p").alias("probability"),
        risk_level(F.col("p")).alias("risk_level"),
        confidence(F.col("p")).alias("confidence"),
        F.lit(len(features)).alias("features_used"),
        F.lit(None).cast("string").alias("error"),
    )
    refused = checked.where("error IS NOT NULL").select(*keep, "error")
    return answered.unionByName(refused, allowMissingColumns=True)
