"""No-fire points from the free area: nothing of it is lost, draws are even, scarce room is found, none is said to be none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderspark.operators import sampling
from cinderspark.operators.freearea import drawn_places, free_area
from cinderspark.params import Box, Negatives

KM = 111.0


def fires_at(spark, places):
    rows = [(i, float(a), float(b), "2020-01-01") for i, (a, b) in enumerate(places)]
    return spark.createDataFrame(rows, "pid bigint, lat double, lon double, date string").withColumn("date", F.col("date").cast("date"))


def nearest(places, fires):
    return np.sqrt(((places[:, None, :] - np.array(fires)[None]) ** 2).sum(axis=2)).min(axis=1) * KM


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_leaves_hold_all_free_places_and_their_numbers_have_no_gap(spark, depth):
    rng = np.random.default_rng(depth)
    fires = rng.uniform(-0.1, 1.1, (60, 2)).tolist()
    box = Box(0.0, 1.0, 0.0, 0.7)
    area = free_area(spark, fires_at(spark, fires), 12.0, box, depth)
    leaves = sorted(area.leaves.collect(), key=lambda r: r["code"])
    assert [r["before"] for r in leaves] == [0, *np.cumsum([r["count"] for r in leaves]).tolist()[:-1]]
    assert area.total == sum(r["count"] for r in leaves)
    codes = [(r["code"] + k, r["cut"]) for r in leaves for k in range(r["count"])]
    cells = spark.createDataFrame(codes, "code bigint, cut boolean")
    place = area.place(F.col("code"), F.lit(0.5), F.lit(0.5))
    known = {(round(r["a"], 9), round(r["b"], 9)): r["cut"] for r in cells.select(place[0].alias("a"), place[1].alias("b"), "cut").collect()}
    assert len(known) == len(codes)
    tried = np.column_stack([rng.uniform(0, 1.0, 4000), rng.uniform(0, 0.7, 4000)])
    middle = (np.floor(tried / [area.height, area.width]) + 0.5) * [area.height, area.width]
    for where, km in zip(middle.tolist(), nearest(tried, fires).tolist(), strict=True):
        cut = known.get((round(where[0], 9), round(where[1], 9)))
        if km >= 12.0:
            assert cut is not None
        else:
            assert cut is not False


def test_draws_are_even_over_the_free_area(spark):
    fires = fires_at(spark, [(0.5, 0.5)])
    rules = Negatives(ratio=4000.0, min_km=30.0, box=Box(0.0, 1.0, 0.0, 1.0))
    got = sampling.negatives_in_space(fires, rules).select("lat", "lon").toPandas().to_numpy()
    assert len(got) == 4000 and (nearest(got, [(0.5, 0.5)]) >= 30.0).all()
    corners = [((got[:, 0] < 0.5) == a) & ((got[:, 1] < 0.5) == b) for a in (True, False) for b in (True, False)]
    assert all(abs(c.sum() - 1000) < 120 for c in corners)
    # A corner square of side 0.2 is wholly free.
    free = 1 - np.pi * (30 / KM) ** 2
    assert abs(((got < 0.2).all(axis=1)).sum() - 4000 * 0.04 / free) < 60


def test_a_hole_of_less_than_a_thousandth_of_the_box_is_filled(spark):
    side, hole = 0.02, (0.503, 0.507)
    fires = [(a, b) for a in np.arange(-0.1, 1.12, side) for b in np.arange(-0.1, 1.12, side) if max(abs(a - hole[0]), abs(b - hole[1])) > 0.03]
    radius = nearest(np.array([hole]), fires)[0] - 0.25
    lattice = np.array([(a, b) for a in np.arange(0.3, 0.7, 0.002) for b in np.arange(0.3, 0.7, 0.002)])
    assert (nearest(lattice, fires) >= radius).sum() * 0.002**2 < 5e-4
    rules = Negatives(ratio=1.0, min_km=float(radius), box=Box(0.0, 1.0, 0.0, 1.0))
    targets = fires_at(spark, fires)
    found = sampling.negatives_in_space(targets, rules)
    got = found.select("lat", "lon").toPandas().to_numpy()
    assert len(got) == len(fires) and (nearest(got, fires) >= radius).all()
    assert tuple(sampling.shortfall(targets, found, rules).first()) == (len(fires), len(fires))


def test_no_room_one_place_and_a_flat_box(spark):
    hot = fires_at(spark, [(0.5, 0.5)] * 300)
    covered = Negatives(min_km=500.0, box=Box(0.4, 0.6, 0.4, 0.6))
    assert free_area(spark, hot, 500.0, covered.box).total == 0
    assert sampling.negatives_in_space(hot, covered).count() == 0
    line = Negatives(min_km=10.0, box=Box(0.0, 0.0, 0.0, 1.0))
    got = sampling.negatives_in_space(hot, line).toPandas()
    assert len(got) == 300 and (got.lat == 0).all()
    area = free_area(spark, hot.limit(0), 50.0, Box(0.0, 1.0, 0.0, 1.0))
    assert area.leaves.where("cut").count() == 0
    ids = spark.range(50).withColumnRenamed("id", "pid")
    assert drawn_places(ids, area, *[sampling.uniform(F.col("pid"), s) for s in ("a", "b", "c")]).count() == 50


def test_wet_days_do_not_make_cells_smaller(spark, monkeypatch):
    """One day in a hundred is dry: the places are as good as before, so one free area is enough."""
    made = []
    monkeypatch.setattr(sampling, "free_area", lambda *args: made.append(args) or free_area(*args))
    rows = [(i, 0.5, 0.5, f"2020-0{1 + i % 4}-{1 + i % 28:02d}") for i in range(60)]
    fires = spark.createDataFrame(rows, "pid bigint, lat double, lon double, date string").withColumn("date", F.col("date").cast("date"))
    dry = lambda tried: tried.withColumn("mm", F.when(F.col("date") == "2020-02-03", 0.0).otherwise(50.0))
    rules = Negatives(min_km=30.0, box=Box(0.0, 1.0, 0.0, 1.0))
    got = sampling.negatives_in_space(fires, rules, dry).toPandas()
    assert len(got) == 60 and set(got.date.astype(str)) == {"2020-02-03"} and len(made) == 1
    wet = lambda tried: tried.withColumn("mm", F.lit(50.0))
    assert sampling.negatives_in_space(fires, rules, wet).count() == 0
