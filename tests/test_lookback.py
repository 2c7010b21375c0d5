"""Look-back windows against a day-by-day walk, and their properties."""

from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderspark.operators import lookback, windowstats
from cinderspark.params import Lookback

DAY0 = date(2020, 1, 1)


def walk(rain: dict, end: date, p: Lookback) -> date:
    total = 0.0
    for back in range(1, p.max_days + 1):
        day = end - timedelta(days=back)
        mm = rain.get(day, 0.0)
        if mm >= p.daily_min:
            total += mm
            if total >= p.cum_min:
                return day + timedelta(days=1)
    return end - timedelta(days=p.max_days)


def frames(spark, rain: dict, ends: list[date]):
    series = spark.createDataFrame([(1, d, float(v)) for d, v in rain.items()], "cell int, day date, mm double")
    anchors = spark.createDataFrame([(i, 1, d) for i, d in enumerate(ends)], "pid long, cell int, date date")
    return anchors, series


def starts(spark, rain, ends, p: Lookback):
    anchors, series = frames(spark, rain, ends)
    out = lookback.backward_threshold_window(anchors, series, "cell", "day", "mm", p.daily_min, p.cum_min, p.max_days)
    return {r["pid"]: r for r in out.collect()}


def random_rain(seed: int, days: int = 400) -> dict:
    rng = np.random.default_rng(seed)
    return {DAY0 + timedelta(days=int(d)): float(rng.integers(0, 40)) / 2 for d in rng.choice(days, days // 2, replace=False)}


@pytest.mark.parametrize(
    "p",
    [Lookback(), Lookback(daily_min=10, cum_min=100), Lookback(daily_min=0.1, cum_min=30), Lookback(daily_min=0, cum_min=55), Lookback(max_days=7)],
)
def test_same_as_the_walk(spark, p):
    rain = random_rain(1)
    ends = [DAY0 + timedelta(days=d) for d in range(0, 480, 3)]
    got = starts(spark, rain, ends, p)
    assert {i: r["dtw_start"] for i, r in got.items()} == {i: walk(rain, d, p) for i, d in enumerate(ends)}
    assert all(r["dtw_end"] == ends[i] and 0 <= r["dtw_length"] <= p.max_days for i, r in got.items())


@pytest.mark.parametrize("lags", [lookback.MAX_LAGS, 0])
def test_thresholds_that_do_not_divide_in_binary(spark, monkeypatch, lags):
    monkeypatch.setattr(lookback, "MAX_LAGS", lags)
    rain = {DAY0 + timedelta(days=d): 0.1 for d in range(60)}
    ends = [DAY0 + timedelta(days=d) for d in range(5, 70)]
    for p in (Lookback(daily_min=0.1, cum_min=0.8), Lookback(daily_min=0.1, cum_min=0.3)):
        got = starts(spark, rain, ends, p)
        assert {i: r["dtw_start"] for i, r in got.items()} == {i: walk(rain, d, p) for i, d in enumerate(ends)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=20, max_size=120), st.integers(10, 60))
def test_properties(spark, halves, more):
    rain = {DAY0 + timedelta(days=i): h / 2 for i, h in enumerate(halves)}
    ends = [DAY0 + timedelta(days=d) for d in (5, len(halves), len(halves) + 40)]
    base = starts(spark, rain, ends, Lookback())
    higher = starts(spark, rain, ends, Lookback(cum_min=30.0 + more))
    drier = starts(spark, {**rain, DAY0 - timedelta(days=3): 1.0}, ends, Lookback())
    for i in base:
        assert base[i]["dtw_length"] <= higher[i]["dtw_length"] <= 90
        assert base[i]["dtw_start"] == drier[i]["dtw_start"]


def test_points_without_date_are_dropped_and_duplicates_kept(spark):
    anchors = spark.createDataFrame([(1, 1, DAY0), (2, 1, DAY0), (3, 1, None), (4, None, DAY0)], "pid long, cell int, date date")
    series = spark.createDataFrame([(1, DAY0 - timedelta(days=4), 31.0)], "cell int, day date, mm double")
    got = {r["pid"]: r["dtw_length"] for r in lookback.backward_threshold_window(anchors, series, "cell", "day", "mm").collect()}
    assert got[1] == got[2] == 3 and 3 not in got and 4 in got


def test_dense_series_and_statistics(spark):
    rain = random_rain(2)
    ends = [DAY0 + timedelta(days=d) for d in (30, 200, 399)]
    anchors, series = frames(spark, rain, ends)
    windows = anchors.select("pid", "cell", F.date_sub("date", 6).alias("dtw_start"), F.col("date").alias("dtw_end"))
    arrays = lookback.daily_arrays(windows, series, ["cell"], "day", ["mm"], fill=0.0)
    long = lookback.daily_values(windows, arrays, ["pid"] + ["cell", "dtw_start", "dtw_end"]).toPandas()
    assert (long.groupby("pid").size() == 7).all()
    stats = windowstats.rain_statistics(windows, series, ["cell"]).toPandas().set_index("pid")
    for i, end in enumerate(ends):
        values = [rain.get(end - timedelta(days=k), 0.0) for k in range(7)]
        got = stats.loc[i]
        assert got.prec_min == min(values) and got.prec_max == max(values)
        assert got.prec_median == np.median(values)
        assert got.prec_sum == pytest.approx(sum(values)) and got.prec_mean == pytest.approx(np.mean(values))


def test_empty_window_statistics_are_null(spark):
    windows = spark.createDataFrame([(9, DAY0, DAY0 + timedelta(days=3))], "cell int, dtw_start date, dtw_end date")
    series = spark.createDataFrame([(1, DAY0, 300.0)], "cell int, day date, kelvin double")
    row = windowstats.temperature_statistics(windows, series, ["cell"]).first()
    assert [row[f"lst_{s}"] for s in ("min", "median", "mean", "max")] == [None] * 4
    dry = windowstats.rain_statistics(windows, series.withColumnRenamed("kelvin", "mm"), ["cell"]).first()
    assert dry["prec_sum"] == 0.0 and dry["n_missing"] == 4


def test_too_long_window_fails_loudly(spark):
    windows = spark.createDataFrame([(1, DAY0, DAY0 + timedelta(days=200))], "cell int, dtw_start date, dtw_end date")
    series = spark.createDataFrame([(1, DAY0, 1.0)], "cell int, day date, mm double")
    with pytest.raises(Exception, match="window longer"):
        windowstats.rain_statistics(windows, series, ["cell"]).collect()
