"""How the tokens of two tokenizers lie over each other, and which pairs of their ids meet most often.

Both tokenize the same bytes. The union of the places where tokens end cuts a text into stretches, each of which is
one link between a token of A and a token of B; places where both end cut it into groups. Counting which documents
hold a pair is an external sort: every task spills its (pair, document) records as sorted runs, compressed by zstd and
cut by the radix of the A id; runs are merged by a heap, a bounded number at a time; merged runs are in the order of A
ids, then B ids, so that an A id's highest count is known as soon as the next A id comes; and counts go back to the
records of each run as they stream by.
"""

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch, byte_slices, tasks_of
from cinderspark.llm.scanned import ScanEncoder
from cinderspark.llm.tokens import default_tokenizer

# Documents of a run, so that a record's place fits beside its pair in 64 bits.
RUN_DOCS = 1 << 20
# Parts a run is cut into, by the low digits of the A id.
RADIX = 128
# Pieces a worker remembers, twice; some 100 MB.
MEMO_PIECES = 250_000


@dataclass(frozen=True)
class Spill:
    """``run_records``: records (a pair in a document) that a task sorts at a time, some 100 MB with what sorting needs;
    ``fan_in``: runs that one merge takes; ``block_pairs``: pairs of a block of a merged run; ``runs_a_task``: runs that a
    task answers. None of them changes a result."""

    run_records: int = 1_500_000
    fan_in: int = 64
    block_pairs: int = 1 << 16
    runs_a_task: int = 64


ONE_BLANK_RUN = re.compile(r" +[^ ]*")


class PlainEncoder(ScanEncoder):
    """Token ids where control strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        letters = {letter: byte for byte, letter in self.letters.items()}
        parts = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        spelled = [bytes(map(letters.__getitem__, p)) if all(c in letters for c in p) else p.encode() for p in parts]
        self.parts = Parts(spelled)


class SentenceEncoder:
    """Ids of a sentencepiece model that spells blanks as U+2581, puts one before each text and has no piece where one
    follows another letter; a text may then be cut before each run of blanks, and what was cut is remembered. Models
    that normalise or are of another kind encode texts whole."""

    BLANK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        spelled = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.parts = Parts(spelled)
        same = "a   ﬁ① é "
        self.splits = all(self.BLANK not in p.lstrip(self.BLANK) for p in pieces) and self.model.normalize(same) == (" " + same).replace(" ", self.BLANK)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blank = np.array([self.model.piece_to_id(self.BLANK)], "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1) if text else [], "<u4").tobytes()

    def _remember(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of those of ``parts`` that are not remembered, asked of the model together."""
        if len(self.memo) >= MEMO_PIECES:
            # What is in use comes back from the older half.
            self.older, self.memo = self.memo, {}
        self.memo.update({p: self.older[p] for p in parts - self.memo.keys() if p in self.older})
        new = list(parts - self.memo.keys())
        # The model puts back the blank that is taken off here; of nothing it makes nothing.
        ids = self.model.encode([p[1:] for p in new], num_threads=1)
        found = {p: array("I", i).tobytes() if len(p) > 1 else self.blank for p, i in zip(new, ids, strict=True)}
        self.memo.update((p, i) for p, i in found.items() if len(p) <= 32)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [ONE_BLANK_RUN.findall(" " + t) if t and self.splits and self.BLANK not in t else None for t in texts]
        also = self._remember({p for parts in cut if parts for p in parts}).get
        get = self.memo.get
        return [self._whole(t) if parts is None else b"".join([get(p) or also(p) for p in parts]) for t, parts in zip(texts, cut, strict=True)]


class Parts:
    """The bytes of all ids of a vocabulary in one buffer, and the ids as text."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.size = len(parts)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.places[ids] - (ends - lengths), lengths) + np.arange(total)]


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two: A for the tokenizers library (byte level), B for sentencepiece."""

    a: str
    b: str


def default_pair() -> Tokenizers:
    import public_tokenizers

    return Tokenizers(default_tokenizer(), public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=1)
def _encoders(files: Tokenizers) -> tuple[PlainEncoder, SentenceEncoder]:
    """One pair per Python worker."""
    return PlainEncoder(files.a), SentenceEncoder(files.b)


@lru_cache(maxsize=1)
def _spelled_ids(files: Tokenizers) -> list[bytes]:
    """Decimal ids with the mark after them: A before another A, A that ends a group, B before another B, B that ends one."""
    a, b = (e.parts.size for e in _encoders(files))
    marks = [(a, ","), (a, "|"), (b, ","), (b, ";")]
    return [f"{i}{mark}".encode() for size, mark in marks for i in range(size)]


@dataclass
class Overlap:
    """Tokens of a stream of texts: ids of A and B, and for each stretch between neighbouring ends its token of A and of B;
    ``shared`` says that both end there. ``bounds_*`` are each text's ends in these arrays."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared: np.ndarray
    bounds_a: np.ndarray
    bounds_b: np.ndarray
    bounds_links: np.ndarray


def overlap(texts: list[bytes], a: list[bytes], b: list[bytes], parts_a: Parts, parts_b: Parts) -> Overlap:
    """Texts whose tokens spell other bytes than the text has get no tokens."""
    lengths = np.array([len(t) for t in texts], np.int64)
    sound = np.ones(len(texts), bool)
    for ids_of, parts in ((a, parts_a), (b, parts_b)):
        ids = np.frombuffer(b"".join(ids_of), "<u4")
        counts = np.array([len(x) // 4 for x in ids_of], np.int64)
        ends = np.cumsum(parts.lengths[ids])
        upto = np.cumsum(counts)
        total = np.concatenate([[0], ends])[upto]
        same = np.diff(total, prepend=0) == lengths
        spelled = parts.spell(ids, ends)
        if same.all():
            wrong = np.flatnonzero(spelled != np.frombuffer(b"".join(texts), np.uint8))
            same[np.searchsorted(np.cumsum(lengths), wrong, "right")] = False
        else:
            places = np.concatenate([[0], total])
            same = np.array([bool(s) and spelled[places[k] : places[k + 1]].tobytes() == texts[k] for k, s in enumerate(same)], bool)
        sound &= same
    kept_a = [x if s else b"" for x, s in zip(a, sound, strict=True)]
    kept_b = [x if s else b"" for x, s in zip(b, sound, strict=True)]
    ids_a, ids_b = np.frombuffer(b"".join(kept_a), "<u4"), np.frombuffer(b"".join(kept_b), "<u4")
    ends_a, ends_b = np.cumsum(parts_a.lengths[ids_a]), np.cumsum(parts_b.lengths[ids_b])
    ends = np.union1d(ends_a, ends_b)
    link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[link_a] == ends) & (ends_b[link_b] == ends) if len(ends) else np.zeros(0, bool)
    bounds_a = np.cumsum([len(x) // 4 for x in kept_a])
    bounds_b = np.cumsum([len(x) // 4 for x in kept_b])
    stops = np.concatenate([[0], ends_a])[bounds_a]
    return Overlap(ids_a, ids_b, link_a, link_b, shared, bounds_a, bounds_b, np.searchsorted(ends, stops, "right"))


def spelled_groups(o: Overlap, size_a: int, size_b: int, spelled: list[bytes]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    last_a, last_b = np.zeros(len(o.a), bool), np.zeros(len(o.b), bool)
    last_a[o.link_a[o.shared]] = True
    last_b[o.link_b[o.shared]] = True
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    upto_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
    upto_a = np.flatnonzero(last_a) + 1
    which = np.empty(len(o.a) + len(o.b), np.int64)
    which[np.arange(len(o.a)) + upto_b[group_a]] = o.a.astype(np.int64) + size_a * last_a
    if len(o.b):
        which[np.arange(len(o.b)) + upto_a[group_b]] = 2 * size_a + o.b.astype(np.int64) + size_b * last_b
    words = list(map(spelled.__getitem__, which.tolist()))
    ends = (o.bounds_a + o.bounds_b).tolist()
    return [b"".join(words[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 1)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def _run_parts(keys: np.ndarray, slots: np.ndarray, size_b: int) -> Iterator[tuple]:
    """(radix, first, keys, counts, slots, times) of records that were sorted by pair and document: ``keys`` are the pairs,
    ``counts`` how many documents hold each, ``slots`` these documents, ``times`` how often each holds it."""
    records, times = np.unique(keys * RUN_DOCS + slots, return_counts=True)
    pairs, docs = records // RUN_DOCS, (records % RUN_DOCS).astype("<u4")
    begins = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    distinct, counts = pairs[begins], np.diff(begins, append=len(pairs))
    radix = distinct // size_b % RADIX
    order = np.argsort(radix, kind="stable")
    cuts = np.searchsorted(radix[order], np.arange(RADIX + 1))
    for r in range(RADIX):
        mine = order[cuts[r] : cuts[r + 1]]
        if not len(mine):
            continue
        n = counts[mine]
        at = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield r, int(distinct[mine[0]]), _pack(distinct[mine].astype("<i8")), _pack(n.astype("<i8")), _pack(docs[at]), _pack(times[at].astype("<i4"))


DOCUMENT = "run bigint, slot int, doc struct<_key:%s>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
RUN = "radix int, first bigint, keys binary, counts binary, slots binary, times binary"


def spilled(docs: DataFrame, files: Tokenizers, key: str = "doc_id", spill: Spill = Spill()) -> DataFrame:
    """Rows of two kinds: one for each document (``radix`` is null) and one for each radix of each run."""
    narrow = docs.select(F.struct(F.col(key).alias("_key")).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    columns = (DOCUMENT % docs.schema[key].dataType.simpleString()) + ", " + RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b = _encoders(files)
        parts_a, parts_b = encode_a.parts, encode_b.parts
        spelled = _spelled_ids(files)
        if parts_a.size * parts_b.size * RUN_DOCS >= 1 << 63:
            raise ValueError("the vocabularies are too large for pairs of 43 bits")
        task, number, slot, held, n_held = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if n_held:
                this = task << 24 | number
                rows = _run_parts(np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held]), parts_b.size)
                for r, first, *data in rows:
                    yield pa.RecordBatch.from_pydict({"run": [this], "radix": [r], "first": [first], **{n: [d] for n, d in zip(("keys", "counts", "slots", "times"), data, strict=True)}})

        def complete(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch[f.name] if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)

        schema = None
        for batch in byte_slices(batches, "_text"):
            if schema is None:
                schema = pa.schema([
                    ("run", pa.int64()), ("slot", pa.int32()), pa.field("doc", batch.schema.field("doc").type), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                    ("groups_sha256", pa.string()), ("radix", pa.int32()), ("first", pa.int64()), *[(n, pa.binary()) for n in ("keys", "counts", "slots", "times")],
                ])
            if n_held >= spill.run_records or slot + batch.num_rows > RUN_DOCS:
                yield from map(complete, flush())
                number, slot, held, n_held = number + 1, 0, [], 0
            texts = batch.column("_text").to_pylist()
            spaced = [" " + t if t else "" for t in texts]
            o = overlap([t.encode() for t in spaced], encode_a.encode(spaced), encode_b.encode(texts), parts_a, parts_b)
            groups = spelled_groups(o, parts_a.size, parts_b.size, spelled)
            n_groups = np.diff(np.concatenate([[0], np.cumsum(o.shared)])[o.bounds_links], prepend=0)
            n_links = np.diff(o.bounds_links, prepend=0)
            slots = np.arange(slot, slot + len(texts), dtype=np.int64)
            yield complete(pa.RecordBatch.from_pydict({
                "run": np.full(len(texts), task << 24 | number), "slot": slots.astype(np.int32), "doc": batch.column("doc"),
                "n_a": np.diff(o.bounds_a, prepend=0), "n_b": np.diff(o.bounds_b, prepend=0), "n_groups": n_groups, "n_links": n_links,
                "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups],
            }))
            if len(o.link_a):
                held.append((o.a[o.link_a].astype(np.int64) * parts_b.size + o.b[o.link_b], np.repeat(slots, n_links)))
                n_held += len(o.link_a)
            slot += len(texts)
        if schema is not None:
            yield from map(complete, flush())

    return narrow.mapInArrow(run, columns)


def merged(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sum the counts of equal keys over sorted blocks that come in the order of their first keys.

    The heap holds what is left of each block under its first key. Once a block begins at ``f``, no key below ``f`` can
    come any more, and what is below it is taken off the heap and counted; so at most one block of each run is held.
    """
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    number = 0

    def below(limit: int | None) -> tuple[np.ndarray, np.ndarray] | None:
        taken = []
        while heap and (limit is None or heap[0][0] < limit):
            _, n, keys, counts = heapq.heappop(heap)
            cut = len(keys) if limit is None else int(np.searchsorted(keys, limit))
            taken.append((keys[:cut], counts[:cut]))
            if cut < len(keys):
                heapq.heappush(heap, (int(keys[cut]), n, keys[cut:], counts[cut:]))
        if not taken:
            return None
        keys = np.concatenate([k for k, _ in taken])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in taken])[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[begins], np.add.reduceat(counts, begins)

    for keys, counts in blocks:
        done = below(int(keys[0]))
        if done is not None:
            yield done
        heapq.heappush(heap, (int(keys[0]), number, keys, counts))
        number += 1
    done = below(None)
    if done is not None:
        yield done


def gathered(blocks: Iterator[tuple[np.ndarray, np.ndarray]], side: int | None, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about ``pairs``; with ``side`` they end only where ``key // side`` changes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n < pairs:
            continue
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = n if side is None else int(np.searchsorted(keys, keys[-1] // side * side))
        if cut:
            yield keys[:cut], counts[:cut]
        held, n = [(keys[cut:], counts[cut:])] if cut < n else [], n - cut
    if n:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        yield keys, counts


def highest(keys: np.ndarray, counts: np.ndarray, side: int) -> np.ndarray:
    """Which pairs have the highest count of their A id; all pairs of an A id stand together."""
    owner = keys // side
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return counts == np.repeat(np.maximum.reduceat(counts, begins), np.diff(begins, append=len(keys)))


def _groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows sorted by ``keys``, group by group, one row at a time. Each group must be read before the next."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        key = tuple(row[k] for k in keys)

        def group(key=key) -> Iterator[dict]:
            nonlocal row
            while row is not None and tuple(row[k] for k in keys) == key:
                yield row
                row = next(rows, None)

        these = group()
        yield key, these
        for _ in these:
            pass


def merge_level(runs: DataFrame, groups: int, side: int | None, tasks: int, block_pairs: int) -> DataFrame:
    """Merge runs (``run``, ``radix``, ``first``, ``keys``, ``counts``) into ``groups`` runs for each radix; with ``side``, pairs that
    have their A id's highest count are marked in ``best``."""
    mixed = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("bigint")
    dealt = runs.select("radix", mixed.alias("run"), "first", "keys", "counts").repartition(tasks, "radix", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, group), rows in _groups_of(batches, ("radix", "run")):
            blocks = ((_unpack(r["keys"], "<i8"), _unpack(r["counts"], "<i8")) for r in rows)
            for keys, counts in gathered(merged(blocks), side, block_pairs):
                best = None if side is None else _pack(highest(keys, counts, side))
                row = {"run": [group], "radix": [radix], "first": [int(keys[0])], "keys": [_pack(keys)], "counts": [_pack(counts)], "best": [best]}
                yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("first", pa.int64()), *[(n, pa.binary()) for n in ("keys", "counts", "best")]])
    sorted_ = dealt.sortWithinPartitions("radix", "run", "first")
    return sorted_.mapInArrow(run, "run bigint, radix int, first bigint, keys binary, counts binary, best binary")


def answered(runs: DataFrame, counted: DataFrame, n_runs: int, tasks: int, runs_a_task: int) -> DataFrame:
    """For each radix of each run: ``slots``, and what the records of this radix add to ``n_best`` and ``count_sum`` there.

    A radix is dealt to as many tasks as its runs need. Each gets the radix's merged pairs, whose number only the
    vocabularies bound and the data hardly moves, and then its runs one by one.
    """
    salts = -(-n_runs // runs_a_task)
    none = F.lit(None).cast("binary")
    pairs = counted.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("bigint").alias("run"),
                           "first", "keys", "counts", "best", none.alias("slots"), none.alias("times"))
    asked = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int").alias("salt"), "run", "first", "keys", "counts", none.alias("best"), "slots", "times")
    dealt = pairs.unionByName(asked).repartition(tasks, "radix", "salt").sortWithinPartitions("radix", "salt", "run", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups_of(batches, ("radix", "salt")):
            blocks, known = [], None
            for r in rows:
                if r["run"] < 0:
                    blocks.append((_unpack(r["keys"], "<i8"), _unpack(r["counts"], "<i8"), _unpack(r["best"], "?")))
                    continue
                if known is None:
                    known = tuple(np.concatenate(x) for x in zip(*blocks, strict=True))
                keys, holders = _unpack(r["keys"], "<i8"), _unpack(r["counts"], "<i8")
                at = np.repeat(np.searchsorted(known[0], keys), holders)
                slots, times = _unpack(r["slots"], "<u4"), _unpack(r["times"], "<i4").astype(np.int64)
                order = np.argsort(slots, kind="stable")
                begins = np.flatnonzero(np.diff(slots[order], prepend=-1))
                best, total = np.add.reduceat((times * known[2][at])[order], begins), np.add.reduceat((times * known[1][at])[order], begins)
                row = {"run": [r["run"]], "slots": [_pack(slots[order][begins])], "best": [_pack(best)], "total": [_pack(total)]}
                yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema([("run", pa.int64()), ("slots", pa.binary()), ("best", pa.binary()), ("total", pa.binary())])
    return dealt.mapInArrow(run, "run bigint, slots binary, best binary, total binary")


def summed(answers: DataFrame, tasks: int) -> DataFrame:
    """(``run``, ``slot``, ``n_best``, ``count_sum``): the answers of all radixes of a run, whose documents are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (this,), rows in _groups_of(batches, ("run",)):
            best, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for r in rows:
                slots = _unpack(r["slots"], "<u4")
                more = int(slots[-1]) + 1 - len(best)
                if more > 0:
                    best, total = np.pad(best, (0, more)), np.pad(total, (0, more))
                best[slots] += _unpack(r["best"], "<i8")
                total[slots] += _unpack(r["total"], "<i8")
            for a in range(0, len(best), 10_000):
                b = min(a + 10_000, len(best))
                columns = [pa.array(np.full(b - a, this)), pa.array(np.arange(a, b, dtype=np.int32)), pa.array(best[a:b]), pa.array(total[a:b])]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "slot", "n_best", "count_sum"])

    dealt = answers.repartition(tasks, "run").sortWithinPartitions("run")
    return dealt.mapInArrow(run, "run bigint, slot int, n_best bigint, count_sum bigint")


@dataclass(frozen=True)
class Alignment:
    """``documents``: one row for each row of the input. ``pairs``: ``a``, ``b``, ``n_docs`` and ``best`` of every linked pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, files: Tokenizers, key: str = "doc_id", spill: Spill = Spill()) -> Alignment:
    """Align two tokenizers over ``docs`` (``key``, ``text``).

    A null or empty text, or one that tokens of A or B do not spell, has no tokens: zeros, and '' for ``groups_sha256``.
    Each row is a document of its own, whatever its key: repeated rows and null keys count as often as they are there.
    Other columns are not read. Control strings are plain text. An empty table gives empty results.
    """
    spark = docs.sparkSession
    scratch, tasks = Scratch(spark, "alignment"), tasks_of(spark)
    side = _encoders(files)[1].parts.size
    rows = scratch.keep(spilled(docs, files, key, spill), "spilled")
    runs = rows.where("radix IS NOT NULL")
    n_runs = runs.agg(F.countDistinct("run")).first()[0]
    level, n, number = runs, n_runs, 0
    while n > spill.fan_in:
        n, number = -(-n // spill.fan_in), number + 1
        level = scratch.keep(merge_level(level, n, None, tasks, spill.block_pairs), f"merged-{number}")
    counted = scratch.keep(merge_level(level, 1, side, tasks, spill.block_pairs), "counted")
    answers = scratch.keep(answered(runs, counted, max(n_runs, 1), tasks, spill.runs_a_task), "answers")
    sums = summed(answers, tasks)
    documents = rows.where("radix IS NULL").select("run", "slot", F.col("doc._key").alias(key), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("bigint")
    result = documents.join(sums, ["run", "slot"], "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
    return Alignment(result, pair_rows(counted, side))


def pair_rows(counted: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c, b in zip(*(batch.column(n).to_pylist() for n in ("keys", "counts", "best")), strict=True):
                keys = _unpack(k, "<i8")
                columns = [keys // side, keys % side, _unpack(c, "<i8"), _unpack(b, "?")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "n_docs", "best"])

    return counted.select("keys", "counts", "best").mapInArrow(run, "a bigint, b bigint, n_docs bigint, best boolean")
