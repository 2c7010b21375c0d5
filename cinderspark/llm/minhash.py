"""Near-duplicate documents: MinHash bands, then sequential Bayesian verification of the candidates.

Documents with the same set of shingles are one class. Bands propose pairs of classes. A pair's short
signatures are compared batch by batch, and it is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below the chosen miss probability. What is left is compared on the
full sets.

Within a band's bucket, pairs are not all listed. First each bucket compares its members to one of them.
Then members that are still in different components are compared inside the tasks, block by block, and
only pairs that pass come out.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch, forget_others, remembers, slices, tasks_of, whole_groups
from cinderspark.llm.components import components

MEMO_WORDS = 500_000


@dataclass(frozen=True)
class NearDuplicates:
    """Shingles of ``words`` words; pairs with 100 * intersection >= ``percent`` * union are linked. With 56 bands of
    7, a pair at 0.8 is missed by all bands with probability 2e-6; ``miss`` is that of each batch of the
    verification. ``stars`` pivots are tried in a bucket before members of different components meet, at most
    ``block`` against ``block`` at a time."""

    words: int = 5
    percent: int = 80
    bands: int = 56
    rows: int = 7
    batch: int = 56
    miss: float = 1e-7
    stars: int = 2
    block: int = 512
    seed: int = 20


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


_WORDS = _Words()
remembers("minhash", _WORDS.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache
def _weights(words: int) -> np.ndarray:
    return np.random.default_rng(words).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the shingles. A-Z are lower-cased; words are split at the six ASCII
    white-space characters. Fewer words than a shingle make one shingle; none make none."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 2)], np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    n = len(hashes) - words + 1
    sums = np.zeros(n, np.uint64)
    for k, weight in enumerate(_weights(words)):
        sums += hashes[k : k + n] * weight
    return np.unique(_mixed(sums))


@lru_cache
def _permutations(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)


def minima(sets: list[np.ndarray], hashes: int, seed: int) -> np.ndarray:
    """A row of ``hashes`` minima for each (not empty) set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out, room = np.empty((hashes, len(sets)), np.uint32), np.empty_like(values)
    for j, (a, b) in enumerate(zip(*_permutations(hashes, seed), strict=True)):
        np.multiply(values, a, out=room)
        np.add(room, b, out=room)
        out[j] = np.minimum.reduceat(room, starts)
    return out.T.copy()


def signatures(docs: DataFrame, rules: NearDuplicates) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class`` (fingerprint of the set), ``bands`` (a key each) and ``signature`` (a byte per
    hash). The last three are null without shingles or without a doc_id: such rows link with nothing."""
    hashes = rules.bands * rules.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("minhash")
        mixers = np.random.default_rng(rules.seed + 1).integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches, 256):
            ids = batch.column("doc_id").to_pylist()
            sets = [shingle_set(text, rules.words) for text in batch.column("text").to_pylist()]
            used = [k for k, s in enumerate(sets) if len(s) and ids[k] is not None]
            classes, bands, short = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            if used:
                low = minima([sets[k] for k in used], hashes, rules.seed)
                keys = (low.astype(np.uint64) * mixers).reshape(len(used), rules.bands, rules.rows).sum(2, dtype=np.uint64)
                keys = _mixed(keys + np.arange(rules.bands, dtype=np.uint64)).view(np.int64)
                bytes_ = _mixed(low.astype(np.uint64)).astype(np.uint8)
                for row, k in enumerate(used):
                    classes[k] = fingerprint(sets[k])
                    bands[k], short[k] = keys[row], bytes_[row].tobytes()
            columns = [
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "bands", "signature"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint, bands array<bigint>, signature binary")


def fingerprint(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``class``, ``set`` (binary: sorted 64-bit fingerprints) of the rows whose text is of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("minhash")
        for batch in slices(batches, 256):
            sets = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
            rows = [(c, s.tobytes()) for c, s in zip(batch.column("class").to_pylist(), sets, strict=True) if fingerprint(s) == c]
            columns = [pa.array([c for c, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "set"])

    return docs.select("class", "text").mapInArrow(run, "class bigint, set binary")


def least_matches(rules: NearDuplicates) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) for each batch.

    Bytes match with probability p = s + (1 - s) / 256 at similarity s. Under a uniform prior the posterior
    of p after m matches of n is Beta(m + 1, n - m + 1); its upper tail at the threshold must reach ``miss``.
    """
    at = rules.percent / 100 + (1 - rules.percent / 100) / 256
    grid = (np.arange(200_000) + 0.5) / 200_000
    steps = []
    for n in range(rules.batch, rules.bands * rules.rows + 1, rules.batch):
        low, high = 0, n
        while low < high:
            m = (low + high) // 2
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            low, high = (low, m) if density[grid >= at].sum() / density.sum() >= rules.miss else (m + 1, high)
        steps.append((n, low))
    return steps


def _beside(pairs: DataFrame, table: DataFrame, **columns: str) -> DataFrame:
    """Columns of both classes of a pair."""
    for side in "ab":
        named = table.select(F.col("class").alias(side), *[F.col(c).alias(f"{new}{side}") for new, c in columns.items()])
        pairs = pairs.join(named, side)
    return pairs


def _likely(buckets: DataFrame, short: DataFrame, scratch: Scratch, rules: NearDuplicates, star: int | None) -> DataFrame:
    """The (``a``, ``b``) of different ``label`` that share a ``key`` and pass the batches: all of them or, in round ``star``,
    those of one drawn member of each bucket (or pair of blocks) with the others. Buckets of over ``block`` members
    are dealt out as pairs of blocks; no pair is a row before it has passed."""
    steps = least_matches(rules)

    def passing(i: np.ndarray, j: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        matches = np.zeros(len(i), np.int64)
        for n, least in steps:
            part = slice(n - rules.batch, n)
            matches += (signatures[i, part] == signatures[j, part]).sum(1)
            alive = matches >= least
            i, j, matches = i[alive], j[alive], matches[alive]
        return i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for table in whole_groups(batches, "group", 2048):
            group, classes, label, n, block = (table.column(c).to_numpy() for c in ("group", "class", "label", "n_shingles", "block"))
            inner = table.column("i").to_numpy() == table.column("j").to_numpy()
            signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(group), -1)
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here = slice(begin, end)
                meet = label[here, None] != label[None, here]
                meet &= 100 * np.minimum(n[here, None], n[None, here]) >= rules.percent * np.maximum(n[here, None], n[None, here])
                if not inner[begin]:
                    meet &= block[here, None] != block[None, here]
                if star is not None:
                    pivot = int(np.argmin(_mixed(classes[here].view(np.uint64) + np.uint64(star))))
                    i, j = np.full(int(meet[pivot].sum()), pivot), np.flatnonzero(meet[pivot])
                else:
                    i, j = np.nonzero(np.triu(meet, 1))
                for k in range(0, len(i), 65_536):
                    x, y = passing(i[k : k + 65_536] + begin, j[k : k + 65_536] + begin, signatures)
                    if len(x):
                        low, high = np.minimum(classes[x], classes[y]), np.maximum(classes[x], classes[y])
                        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    large = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.block)
    large = scratch.keep(large.select("key", F.ceil(F.col("n") / rules.block).cast("int").alias("blocks")), f"large-{star}")
    dealt = buckets.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}
    )
    signed = paired.join(short.select("class", "signature"), "class")
    grouped = signed.select(F.xxhash64("key", "i", "j").alias("group"), "class", "label", "n_shingles", "block", "i", "j", "signature")
    tasks = tasks_of(buckets.sparkSession)
    return grouped.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "a bigint, b bigint").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, rules: NearDuplicates) -> DataFrame:
    """The (``a``, ``b``) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            take = []
            for row, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= rules.percent * (len(x) + len(y) - common):
                    take.append(row)
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return _beside(pairs, sets, s="set").mapInArrow(run, "a bigint, b bigint")


def _joining(buckets: DataFrame, short: DataFrame, named: DataFrame, sets: DataFrame, scratch: Scratch, rules: NearDuplicates) -> DataFrame:
    """Links (``a``, ``b``) that join what is left: all pairs of different ``label`` that share a ``key``.

    A pair is looked at only in the first band it shares, and there with its full sets, in the task. Each task joins the
    labels of its bucket as it finds links and passes over pairs that are joined already, so that it gives fewer
    links than the bucket has members; no pair that could join two labels is left out. Buckets of over ``block`` members
    are dealt out as pairs of blocks.
    """
    steps = least_matches(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for table in whole_groups(batches, "group", 512):
            group, key, classes, label, n, block = (table.column(c).to_numpy() for c in ("group", "key", "class", "label", "n_shingles", "block"))
            inner = table.column("i").to_numpy() == table.column("j").to_numpy()
            signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(group), -1)
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(group), -1)
            full = table.column("set")
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here = slice(begin, end)
                meet = label[here, None] != label[None, here]
                meet &= 100 * np.minimum(n[here, None], n[None, here]) >= rules.percent * np.maximum(n[here, None], n[None, here])
                if not inner[begin]:
                    meet &= block[here, None] != block[None, here]
                i, j = np.nonzero(np.triu(meet, 1))
                above: dict[int, int] = {}

                def root(x: int, above: dict[int, int] = above) -> int:
                    while x in above:
                        x = above[x]
                    return x

                found = []
                for k in range(0, len(i), 16_384):
                    x, y = i[k : k + 16_384] + begin, j[k : k + 16_384] + begin
                    first = (bands[x] == bands[y]).argmax(axis=1)
                    mine = bands[x, first] == key[x]
                    x, y = x[mine], y[mine]
                    matches = np.zeros(len(x), np.int64)
                    for upto, least in steps:
                        part = slice(upto - rules.batch, upto)
                        matches += (signatures[x, part] == signatures[y, part]).sum(1)
                        alive = matches >= least
                        x, y, matches = x[alive], y[alive], matches[alive]
                    for a, b in zip(x.tolist(), y.tolist(), strict=True):
                        one, other = root(int(label[a])), root(int(label[b]))
                        if one == other:
                            continue
                        left, right = (np.frombuffer(full[r].as_py(), np.uint64) for r in (a, b))
                        common = len(np.intersect1d(left, right, assume_unique=True))
                        if 100 * common >= rules.percent * (len(left) + len(right) - common):
                            above[one] = other
                            found.append((min(classes[a], classes[b]), max(classes[a], classes[b])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[side] for f in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

    large = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.block)
    large = scratch.keep(large.select("key", F.ceil(F.col("n") / rules.block).cast("int").alias("blocks")), "large-last")
    dealt = buckets.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}
    )
    left = scratch.keep(buckets.select("class").distinct(), "left")
    of_class = named.join(left, "class").groupBy("class").agg(F.first("bands").alias("bands"))
    of_class = of_class.join(short.select("class", "signature"), "class").join(sets, "class")
    grouped = paired.join(scratch.keep(of_class, "left-sets", rows=500), "class").select(
        F.xxhash64("key", "i", "j").alias("group"), "key", "class", "label", "n_shingles", "block", "i", "j", "signature", "bands", "set"
    )
    tasks = tasks_of(buckets.sparkSession)
    return grouped.repartition(tasks, "group").sortWithinPartitions("group", "key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, rules: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links) and ``kept`` (it is the doc_id).

    Null and empty texts have no shingles, link with nothing and are kept; so are rows without a doc_id, whose
    component is null. Rows that repeat a document each get its result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.keep(signatures(docs, rules), "signed")
    named = signed.where(F.col("class").isNotNull())

    banded = named.select(F.explode("bands").alias("key"), "class", "n_shingles")
    # Buckets of one class are over. Copies of a class count once.
    shared = banded.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where(F.col("low") != F.col("high"))
    shared = scratch.keep(shared.select("key"), "shared")
    members = scratch.keep(banded.join(shared, "key").distinct(), "members")
    chosen = members.select("class").distinct()
    short = named.join(chosen, "class").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    short = scratch.keep(short, "short")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(short.select("doc_id", "class"), "doc_id")
    # Rows that repeat a doc_id are one row here again.
    sets = scratch.keep(full_sets(texts, rules.words).groupBy("class").agg(F.first("set").alias("set")), "sets")

    buckets, links = members.withColumn("label", F.col("class")), None
    for step in range(rules.stars + 1):
        if step < rules.stars:
            likely = scratch.keep(_likely(buckets, short, scratch, rules, step), f"pairs-{step}")
            more = scratch.keep(_similar(likely, sets, rules), f"links-{step}", rows=500)
        else:
            more = scratch.keep(_joining(buckets, short, named, sets, scratch, rules), "links-last", rows=500)
        links = more if links is None else links.unionByName(more)
        labels = components(links, scratch, f"components-{step}")
        if step < rules.stars:
            found = members.join(labels, F.col("class") == F.col("node"), "left")
            labelled = scratch.keep(found.select("key", "class", "n_shingles", F.coalesce("component", "class").alias("label")), f"labelled-{step}")
            # Buckets of one component are over.
            mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where(F.col("l") != F.col("h"))
            buckets = labelled.join(scratch.keep(mixed.select("key"), f"mixed-{step}"), "key")

    classes = named.groupBy("class").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(labels, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("component", "class"))
    rooted = scratch.keep(rooted.select("class", "first", "label"), "rooted")
    lowest = scratch.keep(rooted.groupBy("label").agg(F.min("first").alias("component_id")), "lowest")
    of_class = scratch.keep(rooted.join(lowest, "label").select("class", "component_id"), "classes")
    linked = named.join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    alone = signed.where(F.col("class").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).withColumn("kept", same)


def expected_misses(similarity: float, rules: NearDuplicates) -> float:
    """Probability that no band proposes a pair of this similarity."""
    return math.pow(1 - similarity**rules.rows, rules.bands)
