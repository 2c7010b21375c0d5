"""Exact top-k and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from cinderspark.llm.itq import NearVectors, learn_rotation, near_vectors, pieces_and_tables
from cinderspark.llm.topk import TopK, candidates, exact_top_k, products
from tests.llm.cases import rows_of
from tests.llm.test_text_dedup import roots

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, data string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1.0, "x") for i, v, label in rows], SCHEMA)


def vectors(seed=1, n=400, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * rng.choice([0.1, 1, 3], (n, 1))
    base[n // 2 : n // 2 + 60] = base[0] + rng.normal(size=(60, d)) * 0.02 * np.linalg.norm(base[0])
    rows = [(i, base[i].astype(np.float32).tolist(), int(i % 3) if i < n // 2 else 0) for i in range(n)]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(5)]
    odd = [None, [0.0] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(1100 + k, v, 0) for k, v in enumerate(odd)] + [(1200, rows[5][1], None), (None, rows[5][1], 0), (100, rows[100][1], rows[100][2])]
    return rows


def good(v):
    return v is not None and None not in v and all(map(math.isfinite, v))


@pytest.mark.parametrize("rules", [TopK(k=10), TopK(k=3, bucket=16, queries=2, coordinate_from=0.1, every=50), TopK(k=500, bucket=64)])
def test_top_k(spark, rules):
    rows = [(i, v) for i, v, _ in vectors() if i is not None and good(v)]
    whole = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in rows]
    want = []
    for i in sorted({i for i, _ in whole if i % rules.every == 0}):
        q = next(v for j, v in whole if j == i)
        found = sorted((-int(q @ v), j) for j, v in whole if j != i and len(v) == len(q))[: rules.k]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert rows_of(exact_top_k(frame(spark, vectors()), rules), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert exact_top_k(frame(spark, []), rules).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for bits in (10, 30, 45):
        q, v = rng.integers(-(1 << bits), 1 << bits, (3, 8)), rng.integers(-(1 << 14), 1 << 14, (5, 8))
        assert products(q, v).tolist() == [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q]


def test_pruning_loses_nothing():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 8)) * 1000
    v = np.floor(v[np.argsort(-np.linalg.norm(v, axis=1))])
    lengths = np.linalg.norm(v, axis=1)
    for q in np.floor(rng.normal(size=(50, 8)) * 1000):
        scores = v @ q
        for bound in np.sort(scores)[[-1, -10, -100]]:
            left = candidates(q, float(np.linalg.norm(q)), float(bound), v / lengths[:, None], lengths, TopK())
            assert set(np.flatnonzero(scores >= bound)) <= set(left.tolist())
    assert len(candidates(q, float(np.linalg.norm(q)), float(scores.max()), v / lengths[:, None], lengths, TopK())) < 250


@pytest.mark.parametrize("chunk", [512, 8])
def test_near_vectors(spark, chunk):
    rows = vectors()
    usable = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and good(v) and any(v):
            usable[k] = np.array(v, np.float64)
    links = []
    for a in usable:
        for b in usable:
            x, y = usable[a], usable[b]
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    count = [sum(k in link for link in links) for k in range(len(rows))]
    root = roots({i for i, *_ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    want = [(i, count[k], root.get(i), i is None or root[i] == i) for k, (i, *_) in enumerate(rows)]
    got = rows_of(near_vectors(frame(spark, rows), NearVectors(chunk=chunk)), "vec_id", "n_links", "component_id", "kept")
    missed = 1 - sum(r[1] for r in got) / sum(count)
    assert 0 <= missed <= 0.01
    assert missed > 0 or got == sorted(want, key=repr)
    assert near_vectors(frame(spark, []), NearVectors()).count() == 0


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.98 exactly, in codes learnt from other vectors."""
    rng = np.random.default_rng(8)
    rules = NearVectors()
    x = rng.normal(size=(2000, 64))
    y = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (y * x).sum(1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    for rows in (10**4, 10**7):
        bits, tables = pieces_and_tables(rows, rules)
        turns = np.concatenate([learn_rotation(rng.normal(size=(3000, 64)), 20, k) for k in range(-(-bits * tables // 64))], 1)[:, : bits * tables]
        same = ((x @ turns >= 0) == (y @ turns >= 0)).reshape(len(x), tables, bits).all(2)
        assert same.any(1).mean() >= 0.97


@pytest.mark.parametrize("shared", [0.7, 0.9, 0.97])
def test_recall_of_vectors_with_a_large_mean(spark, shared):
    """Vectors of length 1 whose mean has the squared length ``shared``, in pairs a little above the threshold."""
    rng = np.random.default_rng(17)
    d, n = 32, 1000
    common = np.eye(d)[0]
    own = rng.normal(size=(n, d))
    own[:, 0] = 0
    x = math.sqrt(shared) * common + math.sqrt(1 - shared) * own / np.linalg.norm(own, axis=1)[:, None]
    to = rng.normal(size=(n, d))
    to -= (to * x).sum(1)[:, None] * x
    y = 0.9802 * x + math.sqrt(1 - 0.9802**2) * to / np.linalg.norm(to, axis=1)[:, None]
    both = np.concatenate([x, y]).astype(np.float32)
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1)[:, None]
    true = int((unit @ unit.T >= 0.98).sum()) - 2 * n
    got = near_vectors(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(both)])).agg({"n_links": "sum"}).first()[0]
    assert 0 <= 1 - got / true <= 0.006
