"""Token ids, packing, token files and the ledger against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from cinderspark.llm.bytebpe import class_table, code_point_classes
from cinderspark.llm.huffman import canonical_codes, code_lengths, decode, decoding_table, encode, read_corpus, write_corpus
from cinderspark.llm.ledger import Ledger, deletes, document_counts, inserts, revisions
from cinderspark.llm.mixing import word_count
from cinderspark.llm.packing import best_fit_plan, pack_documents, packed_sequences
from cinderspark.llm.token_counts import JUNK, rollup
from cinderspark.llm.tokens import Encoder, default_tokenizer
from tests.llm.cases import frame, rows_of, texts, with_clashes


@pytest.fixture(scope="module")
def tokenizer():
    return Encoder(default_tokenizer()).tokenizer


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_get_the_ids_they_have_in_the_text(tokenizer):
    rng = random.Random(3)
    letters = " \n\t\r\x0b 　'stre.,!?;:abcÀéß½²Ⅷ०中😀́\x00<|>&[]-_\x1c\x85‍ "
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    made += ["a<|endoftext|>b", "", "it's  we'll don't\n\n x", "foo.\n\n  Bar's 12,5 a1b2"] + [t or "" for _, t, *_ in texts()]
    for text, ids in zip(made, Encoder(default_tokenizer()).encode(made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(tokenizer, text)


def test_both_libraries_see_the_same_classes():
    def matches(pattern, text):
        spans = [span for _, span in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)]
        return "".join(text[a:b] for a, b in spans)

    assert (class_table(matches) == code_point_classes()).all()


@pytest.mark.parametrize("capacity", [7, 100, 1024])
def test_plan_places_as_plain_best_fit_does(capacity):
    rng = random.Random(capacity)
    for size in (0, 1, 5, 500, 5000):
        counts = Counter(rng.randint(1, capacity) for _ in range(size))
        bins, seen = defaultdict(list), set()
        for s in best_fit_plan(dict(counts), capacity):
            for r in range(s.low, s.high):
                bins[s.first + (r - s.low) // s.each].append((s.offset + (r - s.low) % s.each * s.length, s.length))
                seen.add((s.length, r))
        assert seen == {(n, r) for n, c in counts.items() for r in range(c)}
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        rooms = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
        assert len(bins) == len(rooms)


def test_packing(spark, tokenizer):
    docs = with_clashes(frame(spark))
    got = pack_documents(docs, default_tokenizer(), 64, 2).collect()
    want = Counter()
    for doc_id, text, *_ in texts():
        ids = [*plain(tokenizer, text), 2]
        end = len(ids) % 64 or 64
        begin = 0
        while begin < len(ids):
            want[doc_id, begin, end - begin, zlib.crc32(np.array(ids[begin:end], "<u4").tobytes())] += 1
            begin, end = end, end + 64
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    whole = packed_sequences(docs, default_tokenizer(), 64, 2).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.n_tokens for r in whole) == 4 * sum(r.length for r in got)
    assert pack_documents(frame(spark, []), default_tokenizer(), 64, 2).count() == 0


@pytest.mark.parametrize("longest", [4, 6, 18])
def test_code_lengths_are_best_and_short_enough(longest):
    rng = np.random.default_rng(longest)
    counts = rng.integers(1, 2000, 16) ** 2
    counts[3] = 0
    lengths = code_lengths(counts, longest)
    assert lengths.max() <= longest and lengths[3] == 0
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1.0
    if longest == 18:  # no limit here: as good as Huffman's tree
        import heapq

        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert cost == int((counts * lengths).sum())


@pytest.mark.parametrize("sizes", [[0, 1, 127, 128, 129, 1000, 0], [], [5]])
def test_code_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    documents = [np.minimum(rng.geometric(0.02, n), 50_256).astype(np.uint32) for n in sizes]
    counts = np.bincount(np.concatenate([*documents, np.arange(3, dtype=np.uint32)]), minlength=10)
    lengths = code_lengths(counts)
    payload, sizes_, points = encode(documents, canonical_codes(lengths), lengths)
    base = np.concatenate([[0], np.cumsum(sizes_)[:-1]]) if sizes else []
    checkpoints = np.concatenate([*[p + 8 * int(b) for p, b in zip(points, base, strict=True)], np.zeros(0, np.int64)])
    runs = np.array([min(128, n - k) for n in sizes for k in range(0, n, 128)], np.int64)
    assert decode(payload, checkpoints, runs, decoding_table(lengths)).tolist() == [int(x) for d in documents for x in d]


def test_token_files(spark, tokenizer, tmp_path):
    folder = f"{tmp_path}/corpus"
    write_corpus(with_clashes(frame(spark)), folder, default_tokenizer(), 2)
    got = read_corpus(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, *_ in texts()), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = Counter((r.doc_id, bytes(r.ids)) for r in got)
    assert ids == Counter((i, np.array([*plain(tokenizer, t), 2], "<u4").tobytes()) for i, t, *_ in texts())
    write_corpus(frame(spark, []), f"{folder}-empty", default_tokenizer(), 2)
    assert read_corpus(spark, f"{folder}-empty").count() == 0


def test_rollup(spark, tokenizer):
    import re

    want = Counter()
    docs = texts()
    first = {}
    for i, t, *_ in docs:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    for i, t, lang, source, _ in docs:
        if t is not None and i is not None and i > first[t]:
            continue
        t = re.sub(JUNK, "", t or "")
        counts = {"words": len(re.findall(r"[^\x20\x09-\x0D]+", t)), "bpe": len(plain(tokenizer, t))}
        for version, n in counts.items():
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += n
    got = rollup(spark, with_clashes(frame(spark)), {"words": word_count}, {"bpe": default_tokenizer()}).collect()
    assert {(r.source, r.lang, r.tokenizer, k): n for r in got for k, n in (("docs", r.n_docs), ("tokens", r.n_tokens))} == dict(want)
    assert rollup(spark, frame(spark, []), {"words": word_count}, {}).count() == 0


def test_batches_count_once(spark, tmp_path):
    counts = document_counts(frame(spark), {"words": word_count}, {})
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("one", inserts(counts)) and not ledger.commit("one", inserts(counts))
    once = rows_of(ledger.totals(), "source", "lang", "n_docs", "n_tokens")
    # What an attempt left that broke off before its mark does not count, and is written over.
    counts.limit(1).select("source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("n_docs"), "n_tokens").write.parquet(f"{tmp_path}/ledger/two")
    (tmp_path / "ledger/two/_SUCCESS").unlink()
    assert rows_of(ledger.totals(), "source", "lang", "n_docs", "n_tokens") == once
    moved = counts.withColumn("source", F.lit("moved"))
    assert ledger.commit("two", revisions(counts, moved))
    assert {r.source for r in ledger.totals().collect()} == {"moved"}
    assert ledger.commit("three", deletes(moved)) and ledger.totals().count() == 0
    assert ledger.committed() == ["one", "three", "two"]
