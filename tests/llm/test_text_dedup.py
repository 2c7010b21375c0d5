"""Near-duplicates, components and repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from cinderspark.llm.common import Scratch
from cinderspark.llm.components import components
from cinderspark.llm.minhash import NearDuplicates, expected_misses, least_matches, near_duplicates
from cinderspark.llm.suffix import Repeats, anchors, hash_suffix_sort, merge_spans, texts_without_repeats, without_repeats
from tests.llm.cases import SPAN, frame, rows_of, texts, with_clashes


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(40)] + [(300, 300 + k) for k in range(50)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "test"), "c")
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {n: c for n, c in roots({n for x in links for n in x}, links).items() if n in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test"), "c").count() == 0


def shingles(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1)))


def expected(rows, words, percent=80):
    sets = [(i, shingles(t, words)) for i, t in rows]
    links = []
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((i, j))
    root = roots({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets), key=repr)


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    got = near_duplicates(with_clashes(frame(spark)), NearDuplicates(words=words))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == expected([(i, t) for i, t, *_ in texts()], words)
    assert near_duplicates(frame(spark, []), NearDuplicates()).count() == 0


def test_groups_of_near_copies_and_chains(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # one large group, with copies in it
        near = list(base)
        near[rng.randrange(120)] = word()
        rows.append((1000 - i, " ".join(near if i % 3 else base)))
    chain = [word() for _ in range(100)]
    for i in range(12):  # each is near to the next only
        chain = [*chain[8:], *[word() for _ in range(8)]]
        rows.append((2000 + i, " ".join(chain)))
    passage = [word() for _ in range(60)]
    rows += [(3000 + i, " ".join([*passage, *[word() for _ in range(40 + i)]])) for i in range(40)]
    got = near_duplicates(frame(spark, [(i, t, None, None, 0) for i, t in rows]), NearDuplicates(words=4))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == expected(rows, 4)


def test_verification_keeps_pairs_at_the_threshold():
    rules = NearDuplicates()
    assert expected_misses(0.8, rules) < 3e-6
    rng = np.random.default_rng(0)
    hits = rng.random((20_000, 392)) < 0.8 + 0.2 / 256
    assert all((hits[:, :n].sum(1) >= least).all() for n, least in least_matches(rules))
    assert least_matches(rules)[-1][1] > 0.6 * 392


def brute(rows, span):
    count = Counter(b[k : k + span] for b in rows for k in range(len(b) - span + 1))
    out = []
    for b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if count[b[k : k + span]] > 1:
                gone[k : k + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))))
    return out


def passages():
    rng = random.Random(2)
    letters = "abcdé \n"
    common = "".join(rng.choices(letters, k=300))
    rows = [t for _, t, *_ in texts()]
    for k in range(60):
        own = lambda: "".join(rng.choices(letters, k=rng.randint(0, 150)))
        a = rng.randrange(200)
        rows.append(own() + common[a : a + rng.randint(10, 100)] + own() + common[: rng.randint(0, 60)])
    rows += ["ab" * 200, "z" * 39, "z" * 40, "z" * 41, "\x00" * 90, common[:40], common[:40], common[:39] + "!"]
    return rows


@pytest.mark.parametrize("rules", [Repeats(span=SPAN, gram=12), Repeats(span=SPAN, gram=12, chunk=4), Repeats(span=SPAN, gram=12, hot=3)])
def test_repeats(spark, rules):
    rows = passages()
    docs = with_clashes(frame(spark, [(k, t, None, None, 0) for k, t in enumerate(rows)]))
    got = {r.doc_id: (bytes(r.kept), [(s.begin, s.end) for s in r.removed]) for r in without_repeats(docs, rules).collect()}
    want = brute([(t or "").encode() for t in rows], SPAN)
    assert [got[k] for k in range(len(rows))] == want


def test_repeats_with_repeated_rows_and_null_ids(spark):
    rows = texts()
    got = without_repeats(frame(spark, rows).select("doc_id", "text"), Repeats(span=SPAN, gram=12)).collect()
    want = brute([(t or "").encode() for _, t, *_ in rows], SPAN)
    assert Counter((r.doc_id, r.text, bytes(r.kept)) for r in got) == Counter((i, t, w[0]) for (i, t, *_), w in zip(rows, want, strict=True))
    assert without_repeats(frame(spark, []).select("doc_id", "text"), Repeats()).count() == 0


def test_texts_keep_their_columns(spark):
    docs = with_clashes(frame(spark))
    got = texts_without_repeats(docs, Repeats(span=SPAN, gram=12))
    assert got.schema == docs.schema
    want = brute([(t or "").encode() for _, t, *_ in texts()], SPAN)
    cut = [None if t is None else w[0].decode(errors="ignore") for (_, t, *_), w in zip(texts(), want, strict=True)]
    assert rows_of(got, "doc_id", "text", "n_chars", "kept") == sorted(
        ((i, c, None if c is None else len(c), 7) for (i, *_), c in zip(texts(), cut, strict=True)), key=repr
    )


def test_anchors_depend_on_the_string_alone():
    rules = Repeats(span=50, gram=10)
    rng = np.random.default_rng(5)
    for text in (rng.integers(0, 3, 400, np.uint8), np.zeros(300, np.uint8), np.tile(np.arange(7, dtype=np.uint8), 60)):
        found = set(anchors(text, rules)[0].tolist())
        for k in range(len(text) - 50 + 1):
            inside, _ = anchors(text[k : k + 50], rules)
            assert len(inside) == 1 and int(inside[0]) + k in found


def test_suffix_sort_is_the_order_of_the_bytes():
    rng = np.random.default_rng(6)
    start = np.repeat([0, 1, 3, 40], [1, 2, 37, 100])
    rows = rng.integers(0, 2, (140, 17), np.uint8)
    order, common = hash_suffix_sort(start, rows)
    want = sorted(range(140), key=lambda k: (start[k], rows[k].tobytes()))
    assert [rows[k].tobytes() for k in order] == [rows[k].tobytes() for k in want]
    for k in range(1, 140):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = next((x for x in range(17) if a[x] != b[x]), 17)
        assert common[k] == (-1 if start[k] == k else same)


def test_merge_spans():
    assert merge_spans([(5, 9), (0, 3), (3, 4), (7, 12), (20, 21)]) == [(0, 4), (5, 12), (20, 21)]
    assert merge_spans([]) == []
