"""Alignment of two tokenizers against plain Python over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from cinderspark.llm.alignment import SentenceEncoder, PlainEncoder, Spill, align, default_pair
from tests.llm.cases import texts, with_clashes

LETTERS = " \n\t\r  ''''stremvld.,!?abcÀß½²Ⅷ०中😀́\x00<|> Ᲊ▁"


def odd_texts(n: int) -> list[str]:
    rng = random.Random(n)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, "</s> <s>a<|endoftext|>", "   ", " ", "a  ", "  a", "", "a▁b", "a" * 700]


@pytest.fixture(scope="module")
def pair():
    return PlainEncoder(default_pair().a), SentenceEncoder(default_pair().b)


def test_ids_are_those_of_the_libraries(pair):
    a, b = pair
    whole = Tokenizer.from_file(default_pair().a)
    whole.encode_special_tokens = True
    made = odd_texts(2000)
    for text, ids in zip(made, a.encode(made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    for text, ids in zip(made, b.encode(made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == b.model.encode(text)


def brute(pair, rows):
    a, b = pair

    def spans(ids, parts):
        out, at = [], 0
        for i in ids:
            out.append((at, at := at + int(parts.lengths[i]), i))
        return out

    def spelled(ids, parts):
        return b"".join(parts.data[parts.places[i] : parts.places[i] + parts.lengths[i]].tobytes() for i in ids)

    counts, docs = Counter(), []
    for key, text in rows:
        ids_a = np.frombuffer(a.encode([" " + text])[0], "<u4").tolist() if text else []
        ids_b = b.model.encode(text) if text else []
        if text and not spelled(ids_a, a.parts) == spelled(ids_b, b.parts) == (" " + text).encode():
            ids_a = ids_b = []
        sa, sb = spans(ids_a, a.parts), spans(ids_b, b.parts)
        links, groups, begin, k = [], [], 0, 0
        for x in sa:
            while sb[k][1] <= x[0]:
                k += 1
            j = k
            while j < len(sb) and sb[j][0] < x[1]:
                links.append((x[2], sb[j][2]))
                j += 1
        for end in sorted({x[1] for x in sa} & {y[1] for y in sb}):
            sides = [",".join(str(x[2]) for x in s if begin < x[1] <= end) for s in (sa, sb)]
            groups.append("|".join(sides))
            begin = end
        counts.update(set(links))
        docs.append((key, ids_a, ids_b, groups, links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    digest = [
        (key, len(x), len(y), len(g), len(p), sum(counts[q] == best[q[0]] for q in p), sum(counts[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for key, x, y, g, p in docs
    ]
    return sorted(digest, key=repr), {k: (n, n == best[k[0]]) for k, n in counts.items()}


def check(spark, pair, rows, spill, spread=6):
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(spread)
    got = align(docs, default_pair(), spill=spill)
    documents, pairs = brute(pair, rows)
    assert sorted((tuple(r) for r in got.documents.collect()), key=repr) == documents
    assert {(r.a, r.b): (r.n_docs, r.best) for r in got.pairs.collect()} == pairs


ODD = [(None, "abc def"), (None, None), (3, "abc def"), (3, "abc def"), (4, None)]


@pytest.mark.parametrize("spill", [Spill(), Spill(run_records=500, fan_in=3, block_pairs=20, runs_a_task=2)])
def test_alignment(spark, pair, spill):
    check(spark, pair, [(k, t) for k, t in enumerate(odd_texts(200))] + ODD + [(r[0], r[1]) for r in texts()], spill)


def test_one_text_in_a_third_of_the_rows_and_an_empty_table(spark, pair):
    check(spark, pair, [(k, "hot text, hot text" if k % 3 else f"cold {k}") for k in range(300)], Spill(run_records=100, fan_in=2, block_pairs=4, runs_a_task=1))
    check(spark, pair, [], Spill(), 1)
