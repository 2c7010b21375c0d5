"""The paths that only large or skewed data take give the same results as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderspark.operators import evaluation, information, quantiles, sampling, skew, spatial, terrain
from cinderspark.operators.boxtree import BoxTree


def test_lookup_splits_hot_keys(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        plain = big.join(table, ["k"], how).select("id", "k", "v").orderBy("id").collect()
        split = skew.lookup(big, table, ["k"], how, rows_per_salt=30).select("id", "k", "v").orderBy("id").collect()
        assert split == plain


def test_running_totals_match_a_plain_window(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), int(w), int(g)) for i, (v, w, g) in enumerate(zip(rng.integers(0, 50, 2000), rng.integers(0, 9, 2000), rng.integers(0, 2, 2000)))]
    df = spark.createDataFrame(rows, "id long, v double, w long, g int")
    got = skew.running_totals(df, "v", {"s": "w"}, ["g"], ["id"]).select("id", "s").toPandas().set_index("id")["s"]
    for g in (0, 1):
        total = 0
        for i, _, w, _ in sorted((r for r in rows if r[3] == g), key=lambda r: (r[1], r[0])):
            total += w
            assert got[i] == total


@pytest.mark.parametrize("bracket", [1, 50, 100_000])
def test_exact_quantiles_whatever_the_brackets(spark, bracket):
    rng = np.random.default_rng(4)
    wide = rng.normal(size=3001) * 10.0 ** rng.integers(-12, 200, 3001)
    ties = rng.integers(0, 5, 3001).astype(float)
    infinite = np.where(ties == 0, -np.inf, np.where(ties == 4, np.inf, wide))
    rows = [(float(a), float(b), None if i % 3 else float(a), float(c), None, float("nan") if i else 3.0) for i, (a, b, c) in enumerate(zip(wide, ties, infinite))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    got = quantiles.exact_quantiles(df, list("abcdef"), shares, bracket)
    assert got["a"] == pytest.approx(np.quantile(wide, shares).tolist(), rel=1e-12)
    assert got["b"] == np.quantile(ties, shares).tolist()
    assert got["c"] == pytest.approx(np.quantile(wide[::3], shares).tolist(), rel=1e-12)
    ordered = np.sort(infinite)
    assert [got["d"][0], got["d"][1], got["d"][-1]] == [-np.inf, -np.inf, np.inf]
    assert got["d"][3] == ordered[1500]
    assert got["e"] == [None] * 6 and got["f"] == [3.0] * 6


def test_quantiles_take_one_mark_a_column(spark, monkeypatch):
    marks, array = [], quantiles.F.array
    monkeypatch.setattr(quantiles.F, "array", lambda *columns: marks.append(len(columns)) or array(*columns))
    df = spark.range(5000).select(F.sqrt("id").alias("a"), (F.col("id") % 7 - 3).cast("double").alias("b"))
    shares = [i / 10 for i in range(1, 10)]
    got = quantiles.exact_quantiles(df, ["a", "b"], shares, 20)
    assert got["a"] == pytest.approx(np.quantile(np.sqrt(np.arange(5000)), shares).tolist(), rel=1e-12)
    assert got["b"] == np.quantile(np.arange(5000) % 7 - 3.0, shares).tolist()
    # A value that fills its bracket is settled by the first pass, so the last ones have column a alone.
    assert max(marks) <= 2 and marks[-1] == 1


def test_quantiles_of_many_columns_and_of_none(spark):
    df = spark.range(30_000, numPartitions=3).select(*[((F.col("id") * 7919 + i) % 30_011).cast("double").alias(f"c{i}") for i in range(24)]).cache()
    got = quantiles.exact_quantiles(df, df.columns, [0.5], 1000)
    wanted = {f"c{i}": float(np.median((np.arange(30_000) * 7919 + i) % 30_011)) for i in range(24)}
    assert {c: v[0] for c, v in got.items()} == wanted
    assert quantiles.exact_quantiles(df, [], [0.5]) == {}


def _clustered(rng, n, hot):
    places = np.column_stack([rng.uniform(28.7, 31.5, n), rng.uniform(77.5, 81, n)])
    places[: int(n * hot)] = [29.5, 79.0] + rng.normal(0, 0.002, (int(n * hot), 2))
    return places


@pytest.mark.parametrize("limit", [64, 4])
def test_near_and_nearest_match_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    fires, points = _clustered(rng, 300, 0.4), _clustered(rng, 500, 0.3)
    points[-1] = [10.0, 10.0]
    points[-2] = fires[-1]
    distance = np.sqrt(((points[:, None, :] - fires[None, :, :]) ** 2).sum(-1)) * 111
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "pid long, lat double, lon double")
    f = spark.createDataFrame([(float(a), float(b)) for a, b in fires], "lat double, lon double")
    near = {r["pid"] for r in spatial.near_ids(p, f, 5.0, limit=limit).collect()}
    assert near == set(np.flatnonzero((distance < 5).any(1)))
    assert {r["pid"] for r in spatial.near_ids(p, f, 5.0, limit=limit, chunk=7).collect()} == near
    kept = {r["pid"] for r in spatial.exclude_near(p, f, 5.0, limit=limit).collect()}
    assert kept == set(range(500)) - near
    got = spatial.nearest_km(p, f, limit=limit).toPandas().set_index("pid")["nearest_km"]
    assert len(got) == 500
    np.testing.assert_allclose(got.sort_index().to_numpy(), distance.min(1), rtol=0, atol=1e-9)
    split = spatial.nearest_km(p, f, limit=limit, chunk=7).toPandas().set_index("pid")["nearest_km"]
    assert split.sort_index().tolist() == got.sort_index().tolist()


def test_hot_place_and_places_that_are_missing(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MAX_LEAVES", 3)
    nan = float("nan")
    p = spark.createDataFrame([(i % 50, 29.0, 79.0) for i in range(300)] + [(90, None, 79.0), (91, nan, 79.0), (92, 30.0, 80.0)], "pid long, lat double, lon double")
    f = spark.createDataFrame([(29.0 + i / 1e4, 79.0) for i in range(200)] * 2 + [(None, 1.0), (nan, 2.0)], "lat double, lon double")
    index = spatial.place_index(f, limit=16)
    assert index.places.count() == 200 and len(index.boxes) == 3
    got = {r["pid"]: r["nearest_km"] for r in spatial.nearest_km(p, f, limit=16, chunk=20).collect()}
    assert len(got) == 53 and got[90] is None and got[91] is None
    assert [got[i] for i in range(50)] == [0.0] * 50 and got[92] == pytest.approx(np.hypot(30 - 29.0199, 1) * 111)
    assert {r["pid"] for r in spatial.near_ids(p, f, 5.0, limit=16, chunk=20).collect()} == set(range(50))
    assert spatial.exclude_near(p, f, 5.0, limit=16, chunk=20).count() == 3


@pytest.mark.parametrize("n", [1, 16, 17, 500])
def test_box_tree_finds_every_candidate(n):
    rng = np.random.default_rng(n)
    low = rng.uniform(0, 10, (n, 2))
    boxes = np.column_stack([low, low + rng.uniform(0, 1, (n, 2)) * (rng.random((n, 1)) < 0.5)])
    y, x = rng.uniform(-2, 12, (2, 300))
    gaps = [np.maximum(np.maximum(boxes[:, k] - v[:, None], v[:, None] - boxes[:, k + 2]), 0) for k, v in ((0, y), (1, x))]
    far = np.hypot(*[np.maximum(np.abs(v[:, None] - boxes[:, k]), np.abs(v[:, None] - boxes[:, k + 2])) for k, v in ((0, y), (1, x))])
    near = np.hypot(*gaps)
    tree = BoxTree(boxes)
    nearest = {(a, b) for place, item, _ in tree.candidates(y, x, step=64) for a, b in zip(place.tolist(), item.tolist())}
    assert nearest == set(zip(*[v.tolist() for v in np.nonzero(near <= far.min(1, keepdims=True))]))
    for radius in (0.5, 2.0):
        cut, settled = set(), set()
        for place, item, done in tree.candidates(y, x, radius, step=64):
            cut |= set(zip(place.tolist(), item.tolist()))
            settled |= set(done.tolist())
        assert settled == set(np.flatnonzero((far < radius).any(1)).tolist())
        rest = (near < radius) & ~(far < radius).any(1, keepdims=True)
        assert cut == set(zip(*[v.tolist() for v in np.nonzero(rest)]))


def test_no_targets(spark):
    p = spark.createDataFrame([(1, 29.0, 79.0)], "pid long, lat double, lon double")
    none = p.limit(0).drop("pid")
    assert spatial.exclude_near(p, none, 5.0).count() == 1
    assert spatial.nearest_km(p, none).first()["nearest_km"] is None


def _digamma(n):
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(np.max(n)) + 1))])
    return harmonic[np.asarray(n, dtype=int) - 1] - np.euler_gamma


def test_digamma(spark):
    got = spark.range(1, 200).select("id", information.digamma(F.col("id")).alias("d")).orderBy("id").toPandas()
    np.testing.assert_allclose(got["d"], _digamma(got["id"]), atol=1e-9)


@pytest.mark.parametrize("block", [information.RANK_BLOCK, 16])
def test_mutual_information_matches_brute_force(spark, block):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=400) + y * 1.5
    df = spark.createDataFrame([(i, float(a), float(rng.normal()), int(b)) for i, (a, b) in enumerate(zip(x, y))], "pid long, x double, noise double, y int")
    separated = information._separated(df, ["x", "noise"], "y", "pid", 42).toPandas()
    got = {r["feature"]: r["mi"] for r in information.mutual_information(df, ["x", "noise"], "y", block=block).collect()}
    for name in ("x", "noise"):
        v, label = separated[name].to_numpy(), separated["_y"].to_numpy()
        m, sizes = [], []
        for i in range(len(v)):
            same = np.sort(np.abs(v[label == label[i]] - v[i]))
            m.append((np.abs(v - v[i]) < same[3]).sum())
            sizes.append((label == label[i]).sum())
        want = _digamma(len(v)) + _digamma(3) - _digamma(sizes).mean() - _digamma(m).mean()
        assert got[name] == pytest.approx(max(0.0, float(want)), abs=1e-6)
    assert got["x"] > got["noise"]


def test_slope_and_aspect_across_blocks(spark):
    rng = np.random.default_rng(7)
    z = rng.uniform(0, 100, (20, 23))
    rows = [(i, j, float(z[i, j])) for i in range(20) for j in range(23) if (i, j) != (10, 11)]
    cells = spark.createDataFrame(rows, "row int, col int, elevation double")
    got = {(r["row"], r["col"]): r for r in terrain.slope_aspect(cells, xres=30, yres=30, block=5).collect()}
    assert len(got) == len(rows)
    for (i, j), r in got.items():
        hole = abs(i - 10) <= 1 and abs(j - 11) <= 1
        if i in (0, 19) or j in (0, 22) or hole:
            assert r["slope"] is None and r["aspect"] is None
            continue
        a = z[i - 1 : i + 2, j - 1 : j + 2]
        dx = ((a[0, 2] + 2 * a[1, 2] + a[2, 2]) - (a[0, 0] + 2 * a[1, 0] + a[2, 0])) / 240
        dy = ((a[2, 0] + 2 * a[2, 1] + a[2, 2]) - (a[0, 0] + 2 * a[0, 1] + a[0, 2])) / 240
        assert r["slope"] == pytest.approx(np.degrees(np.arctan(np.hypot(dx, dy))))
        assert r["aspect"] == pytest.approx((90 - np.degrees(np.arctan2(dy, -dx))) % 360)


def test_flat_ground_has_no_aspect_and_planes_face_downhill(spark):
    for tilt, facing in (((0, 0), None), ((1, 0), 0.0), ((-1, 0), 180.0), ((0, 1), 270.0), ((0, -1), 90.0)):
        rows = [(i, j, float(i * tilt[0] + j * tilt[1])) for i in range(3) for j in range(3)]
        df = spark.createDataFrame(rows, "row int, col int, elevation double")
        assert terrain.slope_aspect(df).where("row = 1 AND col = 1").first()["aspect"] == facing


def test_auc_matches_pairs(spark):
    rng = np.random.default_rng(8)
    y, score = rng.integers(0, 2, 300), rng.integers(0, 20, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, score double")
    pairs = np.sign(score[y == 1][:, None] - score[y == 0][None, :])
    assert evaluation.roc_auc(df).first()["auc"] == pytest.approx((pairs.mean() + 1) / 2)


def test_splits_and_folds_are_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("pid"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    sides = sampling.stratified_split(df, "y").groupBy("y").agg(F.avg(F.col("in_train").cast("int")).alias("s")).collect()
    assert all(r["s"] == 0.8 for r in sides)
    folds = sampling.stratified_folds(df, "y", 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {50, 150}


@pytest.mark.parametrize("block", [10**6, 7])
def test_mutual_information_with_rare_classes_gaps_and_ties(spark, block):
    """A class that has one value of a feature, a class far apart, and equal values; before, the first divided by zero."""
    rows = [(i, float(i % 11), None if i % 4 == 0 else float(i * i % 97), int(i % 3)) for i in range(90)]
    rows += [(200 + i, 1e4 * i, 5.0 if i == 0 else None, 7) for i in range(4)] + [(300, 1.0, 1.0, 9)]
    df = spark.createDataFrame(rows, "pid long, a double, b double, y int")
    part = information._separated(df, ["a", "b"], "y", "pid", 42).toPandas()
    part = part[part["_y"] != 9]
    n_of = part["_y"].value_counts()
    for r in information.mutual_information(df, ["a", "b"], "y", block=block).collect():
        v, y = (part[part[r["feature"]].notna()][c].to_numpy() for c in (r["feature"], "_y"))
        m = []
        for x, c in zip(v, y):
            near = np.sort(np.abs(v[y == c] - x))
            reach = near[min(3, n_of[c] - 1, len(near) - 1)]
            m.append((np.abs(v - x) < reach).sum() if reach else (v == x).sum())
        sizes = n_of[y].to_numpy()
        want = _digamma(np.array([len(v)]))[0] + _digamma(np.minimum(3, sizes - 1)).mean() - _digamma(sizes).mean() - _digamma(np.array(m)).mean()
        assert r["mi"] == pytest.approx(max(0.0, want), abs=1e-6)
