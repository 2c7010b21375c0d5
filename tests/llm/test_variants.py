"""Spelling variants against a comparison of all words with all others."""

import random
import re
import zlib
from collections import Counter

import pytest

from cinderspark.llm.variants import Variants, dropped_letter, one_apart, spelling_variants, word_counts
from tests.llm.cases import texts, with_clashes


def brute_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=2):
    near = {w: sorted((v for v in words if apart(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: n[0] if n and words[n[0]] >= ratio * words[w] else None for w, n in near.items()}
    out = []
    for w in sorted(words):
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def some_words(n: int) -> dict[str, int]:
    rng = random.Random(n)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(n)}
    words |= {"a" * 400, "a" * 401, "a" * 399 + "b", "a" * 33, "a" * 32, "ÿ" * 32, "ÿ" * 33, "a" * 300 + "b" * 100}
    return {w: 2 ** rng.randint(1, 9) + rng.randint(0, 1) for w in sorted(words)}


@pytest.mark.parametrize("rules", [Variants(), Variants(cell_bytes=300, cell_queries=50, bucket=1), Variants(cell_bytes=8, cell_queries=7)])
def test_variants(spark, rules):
    words = some_words(400)
    table = with_clashes(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert sorted(tuple(r) for r in spelling_variants(table, rules).collect()) == brute(words)


def test_one_apart():
    rng = random.Random(1)
    made = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    for a in made:
        for b in made:
            assert one_apart(a, b) == apart(a, b)


def test_counts_and_an_empty_table(spark):
    rows = [(r[0], r[1]) for r in texts()] * 3
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    counts = word_counts(docs, dropped_letter(97))
    assert {r.word: r.n for r in counts.collect()} == brute_counts(rows)
    empty = spelling_variants(word_counts(docs.limit(0), dropped_letter(97)))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
