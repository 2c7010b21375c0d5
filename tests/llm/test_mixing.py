import heapq
import random
import re
from collections import defaultdict

import pytest

from cinderspark.llm.mixing import Mix, mix_sources, sainte_lague, targets
from tests.llm.cases import frame, rows_of, texts, with_clashes


@pytest.mark.parametrize("seed", range(4))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: ({p: rng.choice([0, 1, 5, rng.random() * 10**6]) for p in range(rng.randint(1, 40))}, rng.randint(0, 300)) for g in "ab"}
    groups["one"] = ({0: 3.0}, 17)
    groups["ties"] = ({p: 2.0 for p in range(7)}, 10)
    groups["none"] = ({0: 0.0, 1: 0.0}, 5)
    rows = [(g, p, float(v), s) for g, (votes, s) in groups.items() for p, v in votes.items()]
    got = sainte_lague(spark.createDataFrame(rows, "g string, p int, v double, seats bigint"), ["p"], "seats", "v", ["g"])
    want = []
    for g, (votes, seats) in groups.items():
        quota = dict.fromkeys(votes, 0)
        heap = [(-float(v), p) for p, v in votes.items() if v > 0]
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, p = heapq.heappop(heap)
            quota[p] += 1
            heapq.heappush(heap, (-float(votes[p]) / (2 * quota[p] + 1), p))
        want += [(g, p, q) for p, q in quota.items()]
    assert rows_of(got, "g", "p", "quota") == sorted(want, key=repr)


def filled(sizes, weights, most, total):
    """Fill up by weight, stopping sources at their ceilings, until nothing is left over."""
    out, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(total)
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] > most * sizes[s]}
        if not over:
            return out | {s: share * weights[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1000, None: 10}, {"a": 0, "B": 0}, {"z": 7}, {"a": 1, "b": 1, "c": 100, "é": 900, None: 900}])
def test_targets(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"), Mix()).collect()
    want = filled(sizes, weights, 3, sum(sizes.values()))
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix(spark):
    mix = Mix(block=4, shard=60)
    docs = with_clashes(frame(spark))
    got = mix_sources(docs, mix).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, _, s, _ in texts()), key=repr)
    of = defaultdict(lambda: [0, 0, None, 0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        entry = of[r.source]
        of[r.source] = [entry[0] + r.size, r.source_size, r.target, entry[3] + r.taken]
    for total, source_size, target, taken in of.values():
        assert total == source_size
        assert abs(taken - target) <= 0.05 * target + 40
    assert rows_of(mix_sources(docs.repartition(5), mix), "doc_id", "size", "taken") == rows_of(mix_sources(docs, mix), "doc_id", "size", "taken")
    assert mix_sources(frame(spark, []), mix).count() == 0


def test_equal_documents_are_not_all_treated_alike(spark):
    rows = [(i, "w " * 50, "en", "a" if i % 2 else "b", 100) for i in range(400)]
    got = mix_sources(frame(spark, rows), Mix(block=10, shard=2000)).collect()
    taken = {s: [r.taken for r in got if r.source == s] for s in "ab"}
    assert abs(sum(taken["a"]) - 20_000 / 3) < 60 and abs(sum(taken["b"]) - 40_000 / 3) < 60
    assert len(set(taken["a"])) > 3
