"""Removal of passages that occur more than once, by a hash-compared suffix sort.

Any string of ``span`` bytes has an anchor in it: the ``gram`` bytes whose hash is least, so that equal strings
have their anchors at equal places. Only suffixes around anchors whose gram occurs again are sorted. Of
each such anchor come the bytes that a string of ``span`` bytes around it can reach. Occurrences of a gram are
merge-sorted by what follows it and by what precedes it; two suffixes are compared by a binary search for
their common extension on prefix polynomial hashes, and the extensions found are checked on the bytes. The
string that starts L bytes before an anchor occurs twice if two occurrences agree for L bytes to the left and
``span - gram - L`` to the right.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinderspark.llm.common import Scratch, bundled, forget_others, slices, tasks_of, unbundled, whole_groups


# Contexts a task remembers; some 50 MB.
SEEN = 100_000


@dataclass(frozen=True)
class Repeats:
    """Strings of ``span`` bytes. Occurrences with the same bytes around them that a task sees stand as
    one. Grams with more than ``chunk`` occurrences are compared chunk by chunk; from
    ``hot`` on, all strings around them are counted by hash instead, with counts added up before the shuffle."""

    span: int = 200
    gram: int = 64
    chunk: int = 4096
    hot: int = 50_000

    @property
    def reach(self) -> int:
        return self.span - self.gram


_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    return _power_tables(size)


@lru_cache(maxsize=4)
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2**64, over random letters) of all prefixes along the last axis."""
    up, _ = _powers(rows.shape[-1])
    sums = np.cumsum(_LETTERS[rows] * up[: rows.shape[-1]], axis=-1, dtype=np.uint64)
    return np.concatenate([np.zeros((*rows.shape[:-1], 1), np.uint64), sums], -1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    _, down = _powers(len(data))
    h = (prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, rules: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes): of every string of ``span`` bytes the rightmost gram with the least hash."""
    if len(data) < rules.span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, rules.gram)
    low = np.uint64((1 << 32) - 1)
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    windows, width = rules.reach + 1, 1
    n = len(h) - windows + 1
    while width * 2 <= windows:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[windows - width : windows - width + n])
    at = (low - (least & low)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def hash_suffix_sort(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows within their groups (``start``: where each row's group begins); returns the order and the common
    prefix of each row with the one before it in its group (-1 for the first).

    Bottom-up mergesort in which all rows of a round find their place in the neighbouring run together; a
    comparison is a binary search over prefix hashes. Extensions are verified on the bytes; should hashes have
    collided, the bytes themselves are sorted.
    """
    m, limit = rows.shape
    hashes = prefix_hashes(rows)
    end = np.searchsorted(start, start, "right")
    size = end - start
    place = np.arange(m) - start

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        for _ in range(limit.bit_length()):
            middle = (low + high + 1) // 2
            same = hashes[a, middle] == hashes[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def after(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row a goes behind row b."""
        common = extension(a, b)
        at = np.minimum(common, limit - 1)
        return np.where(common == limit, ties, rows[a, at] > rows[b, at])

    order, width = np.arange(m), 1
    while width < (int(size.max()) if m else 0):
        run = place // width
        low = start + (run ^ 1) * width
        high = np.minimum(low + width, end)
        moving = np.flatnonzero(low < end)
        first, lo, hi, right = low[moving], low[moving].copy(), high[moving].copy(), run[moving] % 2 == 1
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            up = after(order[moving[open_]], order[middle], right[open_])
            lo[open_], hi[open_] = np.where(up, middle + 1, lo[open_]), np.where(up, hi[open_], middle)
        to = np.arange(m)
        to[moving] = start[moving] + (run[moving] // 2) * 2 * width + (place[moving] - run[moving] * width) + (lo - first)
        moved = np.empty_like(order)
        moved[to] = order
        order, width = moved, width * 2

    common = np.full(m, -1, np.int64)
    inner = np.flatnonzero(place > 0)
    common[inner] = extension(order[inner - 1], order[inner])
    alike = rows[order[inner - 1]] == rows[order[inner]]
    true = np.where(alike.all(1), limit, np.argmin(alike, 1)) if len(inner) else common[inner]
    if (true != common[inner]).any():
        keys = np.ascontiguousarray(rows).view(f"V{limit}").ravel()
        text = np.argsort(np.array([x.tobytes() for x in keys], object), kind="stable")
        order = text[np.argsort(start[text], kind="stable")]
        alike = rows[order[inner - 1]] == rows[order[inner]]
        common[inner] = np.where(alike.all(1), limit, np.argmin(alike, 1))
    return order, common


def repeated_starts(group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, rules: Repeats) -> np.ndarray:
    """For each occurrence (rows; occurrences of a gram side by side) and each L in 0..reach: does the string that
    starts L bytes before the anchor occur at another one of them?"""
    reach, gram = rules.reach, rules.gram
    first = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    middle = context[:, reach : reach + gram]
    if (middle != middle[start]).any():
        # Different grams under one hash: sort them apart.
        _, exact = np.unique(middle, axis=0, return_inverse=True)
        back = np.lexsort((exact.ravel(), start))
        both = start[back] * len(start) + exact.ravel()[back]
        out = np.empty((len(group), reach + 1), bool)
        out[back] = repeated_starts(both, context[back], left[back], right[back], rules)
        return out
    order_r, common_r = hash_suffix_sort(start, np.ascontiguousarray(context[:, reach + gram :]))
    order_l, common_l = hash_suffix_sort(start, np.ascontiguousarray(context[:, :reach][:, ::-1]))
    out = np.zeros((len(group), reach + 1), bool)
    class_r, class_l = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for n in range(reach + 1):
        here = np.flatnonzero((left >= n) & (right >= reach - n))
        if len(here) < 2:
            continue
        class_l[order_l] = np.cumsum(common_l < n)
        class_r[order_r] = np.cumsum(common_r < reach - n)
        key = class_l[here] * (len(group) + 1) + class_r[here]
        rank = np.argsort(key, kind="stable")
        same = key[rank][1:] == key[rank][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out[here[rank], n] = twice
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true cells in each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns, ``_text`` (null: empty) and ``_key``, a digest of it."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_text": text, "_key": F.unhex(F.sha2(text.cast("binary"), 256))})


def _anchored(docs: DataFrame, rules: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            found = [anchors(np.frombuffer(t.encode(), np.uint8), rules) for t in texts]
            columns = [
                batch.column("doc_id"), batch.column("_key"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_key", "n_bytes", "at", "grams"])

    narrow = _keyed(docs.select("doc_id", "text")).drop("text")
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, _key binary, n_bytes bigint, at array<bigint>, grams array<bigint>"
    return narrow.mapInArrow(run, schema)


def _cut_out(docs: DataFrame, wanted: DataFrame, rules: Repeats) -> DataFrame:
    """``gram``, ``chunks``, ``text_id``, ``at``, ``left``, ``right``, ``context`` of every wanted anchor.

    Of occurrences with the same full context one keeps it, as a partner for others; all of them are also
    listed without context, which says that every string around them occurs again.
    """
    reach = rules.reach
    keys = (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_stands"))
    texts = _keyed(docs.select("doc_id", "text")).join(
        wanted.select(F.col("_key").alias("_k"), F.col("stands").alias("_stands"), "text_id", "occurrences"), keys
    )
    # Rows that repeat a document are one here.
    once = texts.dropDuplicates(["_k", "_stands"]).select("text_id", "_text", "occurrences.at", "occurrences.gram", "occurrences.chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        # Bytes around an occurrence -> its first row here, and whether a second one has come.
        seen: dict[bytes, list] = {}
        for batch in slices(batches, 64):
            columns = (batch.column(c).to_pylist() for c in ("text_id", "_text", "at", "gram", "chunks"))
            for text_id, text, at, gram, chunks in zip(*columns, strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(rules.span, np.uint8)])
                windows = np.lib.stride_tricks.sliding_window_view(padded, reach + rules.span)
                if len(seen) > SEEN:
                    seen.clear()
                out: list[tuple] = []
                for p, key, parts in zip(at, gram, chunks, strict=True):
                    left, right = min(p, reach), min(len(data) - p - rules.gram, reach)
                    context = windows[p].tobytes()
                    if left == right == reach:
                        first = seen.setdefault(context, [text_id, p, False])
                        if (first[0], first[1]) != (text_id, p):
                            # The common extension covers all that strings around either can reach.
                            twins = [(text_id, p)] if first[2] else [(first[0], first[1]), (text_id, p)]
                            out += [(key, 1, twin, q, left, right, None) for twin, q in twins]
                            first[2] = True
                            continue
                    out.append((key, parts, text_id, p, left, right, context))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), _CONTEXT_TYPES, strict=True)] if out else [pa.array([], k) for k in _CONTEXT_TYPES],
                    names=["gram", "chunks", "text_id", "at", "left", "right", "context"],
                )

    return once.mapInArrow(run, "gram bigint, chunks int, text_id bigint, at bigint, left int, right int, context binary")


_CONTEXT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _sorted_spans(contexts: DataFrame, rules: Repeats) -> DataFrame:
    """``text_id``, ``begin``, ``end`` of repeated strings, by the suffix sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            twins = table.filter(pa.compute.is_null(table.column("context")))
            if len(twins):
                at = twins.column("at").to_numpy()
                columns = [twins.column("text_id").combine_chunks(), pa.array(at - rules.reach), pa.array(at + rules.span)]
                yield pa.RecordBatch.from_arrays(columns, names=["text_id", "begin", "end"])
            table = table.filter(pa.compute.is_valid(table.column("context")))
            if not len(table):
                continue
            group, text_id, at, left, right = (table.column(c).to_numpy() for c in ("group", "text_id", "at", "left", "right"))
            n = len(group)
            context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(n, -1)
            row, first, last = _runs(repeated_starts(group, context, left, right, rules))
            columns = [pa.array(x) for x in (text_id[row], at[row] - last, at[row] - first + rules.span)]
            yield pa.RecordBatch.from_arrays(columns, names=["text_id", "begin", "end"])

    # Every two occurrences of a gram meet in one pair of chunks.
    dealt = contexts.withColumn("chunk", F.pmod(F.xxhash64("text_id", "at"), F.col("chunks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = F.when(F.col("context").isNull(), F.xxhash64("text_id", "at")).when(F.col("chunks") == 1, F.col("gram")).otherwise(
        F.xxhash64("gram", F.least("chunk", "_other"), F.greatest("chunk", "_other"))
    )
    grouped = paired.select(group.alias("group"), "text_id", "at", "left", "right", "context")
    tasks = tasks_of(contexts.sparkSession)
    return grouped.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "text_id bigint, begin bigint, end bigint")


def _counted_spans(contexts: DataFrame, scratch: Scratch, rules: Repeats) -> DataFrame:
    """The same for grams with very many occurrences: all strings around them, counted by hash. Counts are added
    up before the shuffle, and strings that occur once are gone after it."""
    reach, span = rules.reach, rules.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            context = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            prefix = prefix_hashes(context)
            _, down = _powers(context.shape[1])
            h = ((prefix[:, span:] - prefix[:, :-span]) * down[: reach + 1])[:, ::-1]  # by L
            left, right = (batch.column(c).to_numpy()[:, None] for c in ("left", "right"))
            n = np.arange(reach + 1)[None, :]
            row, which = np.nonzero((left >= n) & (right >= reach - n))
            begin = batch.column("at").to_numpy()[row] - which
            # Beside the hash, a second one of the same bytes tells collisions apart.
            other = [blake2b(context[r, reach - k : reach - k + span].tobytes(), digest_size=8).digest() for r, k in zip(row, which, strict=True)]
            columns = [pa.array(h[row, which].view(np.int64)), pa.array(np.frombuffer(b"".join(other), "<i8")), pa.array(batch.column("text_id").to_numpy()[row]), pa.array(begin)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "text_id", "begin"])

    strings = scratch.keep(contexts.mapInArrow(run, "h bigint, g bigint, text_id bigint, begin bigint").distinct(), "hot-strings")
    twice = scratch.keep(strings.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h", "g"), "hot-twice")
    return strings.join(twice, ["h", "g"]).select("text_id", "begin", (F.col("begin") + span).alias("end"))


def without_repeats(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """All columns of ``docs``, ``kept`` (the remaining bytes) and ``removed`` (maximal runs: array of begin, end), which
    take the place of columns of those names.

    Texts are UTF-8 bytes; a null text is empty; matches never cross rows. Rows that repeat a document are
    occurrences of their own. Copies of a text stand as one text that occurs as often.
    """
    narrow, columns = bundled(docs, "doc_id", "text"), [c for c in docs.columns if c not in ("kept", "removed")]
    names, spans = narrow.columns, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def made(batch: pa.RecordBatch, kept: list[bytes], runs: list[list[dict]]) -> pa.RecordBatch:
        parts = [*(batch.column(n) for n in names), pa.array(kept, pa.binary()), pa.array(runs, spans)]
        return pa.RecordBatch.from_arrays(parts, names=[*names, "kept", "removed"])

    schema = narrow.withColumns({"kept": F.lit(b""), "removed": F.array().cast("array<struct<begin:bigint,end:bigint>>")}).schema
    return unbundled(_cut_texts(narrow, rules, made, schema), [*columns, "kept", "removed"], "doc_id", "text", "kept", "removed")


def _cut_texts(docs: DataFrame, rules: Repeats, made: Callable[[pa.RecordBatch, list[bytes], list[list[dict]]], pa.RecordBatch], schema: StructType) -> DataFrame:
    """Rows (of ``schema``) that ``made`` gives for the rows of a batch, what is left of their texts and the runs removed; one
    Python stage does both, as each stage of a task keeps a worker of its own. ``docs`` has doc_id, text and _rest."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    texts = _anchored(docs, rules).groupBy("_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("stands"), F.first("n_bytes").alias("n_bytes"), F.first("at").alias("at"), F.first("grams").alias("grams")
    )
    # Written once, so the numbers stay.
    texts = scratch.keep(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")
    occurrences = texts.select("text_id", F.explode(F.arrays_zip("at", "grams")).alias("o")).select("text_id", "o.at", F.col("o.grams").alias("gram"))
    again = occurrences.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = scratch.keep(again.select("gram", F.ceil(F.col("n") / rules.chunk).cast("int").alias("chunks"), "n"), "grams")

    def contexts(grams: DataFrame, name: str) -> DataFrame:
        found = occurrences.join(grams, "gram").groupBy("text_id").agg(F.collect_list(F.struct("at", "gram", "chunks")).alias("occurrences"))
        wanted = scratch.keep(found.join(texts.select("text_id", "_key", "stands"), "text_id"), name)
        return _cut_out(docs, wanted, rules)

    spans = _sorted_spans(contexts(again.where(F.col("n") <= rules.hot).drop("n"), "wanted"), rules)
    spans = scratch.keep(spans, "spans")
    hot = again.where(F.col("n") > rules.hot).drop("n")
    if not hot.isEmpty():
        cut = scratch.keep(contexts(hot, "wanted-hot"), "contexts-hot")
        twins = cut.where(F.col("context").isNull()).select(
            "text_id", (F.col("at") - rules.reach).alias("begin"), (F.col("at") + rules.span).alias("end")
        )
        counted = _counted_spans(cut.where(F.col("context").isNotNull()), scratch, rules)
        spans = spans.unionByName(scratch.keep(counted, "spans-hot")).unionByName(twins)
    # Spans of one text, which its length bounds.
    listed = spans.distinct().groupBy("text_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= rules.span)
    removed = texts.select("text_id", "_key", "n_bytes", whole.alias("whole")).join(listed, "text_id", "left")
    removed = removed.where(F.col("whole") | F.col("spans").isNotNull()).select(
        F.col("_key").alias("_k"), F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.col("spans")).alias("_spans")
    )
    removed = scratch.keep(removed, "removed")
    scratch.drop("wanted", "wanted-hot", "grams")
    joined = _keyed(docs).join(removed, F.col("_key") == F.col("_k"), "left").drop("_k", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            kept, runs = [], []
            for text, spans_ in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                data = text.encode()
                merged = merge_spans([(s["begin"], s["end"]) for s in spans_ or []])
                parts, at = [], 0
                for begin, end in merged:
                    parts.append(data[at:begin])
                    at = end
                kept.append(b"".join([*parts, data[at:]]))
                runs.append([{"begin": a, "end": b} for a, b in merged])
            yield made(batch, kept, runs)

    return joined.mapInArrow(run, schema)


def texts_without_repeats(docs: DataFrame, rules: Repeats = Repeats()) -> DataFrame:
    """``docs`` with what remains as their ``text`` (and its length as ``n_chars``, if there is such a column). Characters
    that a cut goes through are gone; a null text stays null."""
    narrow = bundled(docs, "doc_id", "text")
    names = narrow.columns

    def made(batch: pa.RecordBatch, kept: list[bytes], _: list[list[dict]]) -> pa.RecordBatch:
        there = batch.column("text").is_valid().to_pylist()
        texts = [left.decode(errors="ignore") if known else None for known, left in zip(there, kept, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("_rest")], names=names)

    result = unbundled(_cut_texts(narrow, rules, made, narrow.schema), docs.columns, "doc_id", "text")
    return result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else result


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged
