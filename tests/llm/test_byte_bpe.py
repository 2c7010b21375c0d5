"""Byte-level BPE against the tiktoken library, and back."""

import random

import numpy as np
import pytest
import tiktoken

from cinderspark.llm import bytebpe, merging
from cinderspark.llm.bytebpe import ByteBPE, byte_bpe, decoded, default_ranks, encoded, piece_starts, scan, texts_as_codes
from tests.llm.cases import texts, with_clashes

LETTERS = " \n\t\r  ''''stremvld.,!?abcÀß½²Ⅷ०中😀́\x00<|> Ᲊ"
CHOSEN = ["a" * 3000, "", "ab" * 3000 + " '", "  ", "'s", "don't I'll we've they're 's'll 'tis ''s '", "<|endoftext|>", "x 's\n's  's"]


def made(n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + CHOSEN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=byte_bpe(default_ranks()).ranks, special_tokens={})


@pytest.mark.parametrize("window,block", [(1 << 20, 64), (97, 5), (1, 2)])
def test_ids_are_those_of_the_library(library, monkeypatch, window, block):
    monkeypatch.setattr(bytebpe, "WINDOW", window)
    monkeypatch.setattr(bytebpe, "BLOCK", block)
    bpe = byte_bpe(default_ranks())
    some = made(2000 if window > 1 else 50)
    for text, ids in zip(some, bpe.encode(*texts_as_codes(some)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(np.frombuffer(ids, "<u4"), bpe.offsets(ids)).tobytes() == text.encode()


def test_scan_composes_in_any_grouping():
    _, composed, _ = bytebpe._machine()
    rng = np.random.default_rng(2)
    some = rng.integers(0, len(composed), 5000).astype(np.uint16)
    want, at = [], 0
    for f in some.tolist():
        want.append(at := int(composed[at, f]))
    assert scan(some, composed).tolist() == want


def test_a_stretch_of_tokens_decodes_alone_and_faults_raise():
    bpe = byte_bpe(default_ranks())
    text = "Some words, and more of them: naïve 中文."
    (ids,) = bpe.encode(*texts_as_codes([text]))
    tokens, offsets = np.frombuffer(ids, "<u4"), bpe.offsets(ids)
    assert bpe.decode(tokens[3:7], offsets[3:7]).tobytes() == text.encode()[offsets[3] : offsets[7]]
    with pytest.raises(ValueError):
        bpe.decode(tokens, offsets + np.arange(len(offsets)))
    with pytest.raises(ValueError):
        bpe.decode(np.array([10**6]), np.array([0]))


@pytest.mark.parametrize("cells", [1 << 19, 40])
def test_many_pieces_merge_as_one_does(monkeypatch, cells):
    monkeypatch.setattr(merging, "CELLS", cells)
    merger = ByteBPE(byte_bpe(default_ranks()).ranks).merger
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"abtheringo\xc3\xa9 ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert merger.merge_many(pieces) == [merger._merge_long(p) for p in pieces]
    assert merger.merge_many([]) == []


def test_classes_of_empty_and_border_texts():
    _, codes, first, _ = texts_as_codes(["", "a ", "", " b", " ", ""])
    assert piece_starts(codes, first, bytebpe.code_point_classes()).tolist() == [True, True, True, False, True]


def test_rows(spark, library):
    rows = [(r[0], r[1]) for r in texts()] + list(enumerate(made(100)))
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = decoded(encoded(docs, default_ranks()), default_ranks()).collect()
    want = [(k, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in got), key=repr) == sorted(want, key=repr)
    assert decoded(encoded(docs.limit(0), default_ranks()), default_ranks()).collect() == []
