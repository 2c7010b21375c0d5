"""Token ids in a compact file format: canonical, length-limited Huffman codes from global counts.

Format, version 1, two tables in one folder:

* ``codebook``: ``id``, ``bits``. Codes are canonical: in rising order of (bits, id), each the one before plus one.
* ``blocks``, sorted by ``doc_id`` within and across ``part``: ``part``, ``block``, ``start`` (ids of the part before),
  ``n_ids``, ``payload`` and the directories ``doc_ids`` (nullable), ``doc_n_ids``, ``doc_bytes`` and ``checkpoints``. A
  document's code starts at a byte. ``checkpoints`` has the bit offset in the payload of every ``STRIDE``-th id
  of every document, so that a block decodes alone and from many points at a time. A block closes at the
  end of a document, after ``BLOCK_IDS`` ids or more.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch, forget_others, remove, slices, tasks_of
from cinderspark.llm.tokens import encoded

LONGEST = 18
STRIDE = 128
BLOCK_IDS = 65_536
BLOCK = (
    "part int, block int, start bigint, n_ids bigint, payload binary, doc_ids array<bigint>, "
    "doc_n_ids array<bigint>, doc_bytes array<bigint>, checkpoints binary"
)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 for a count of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit into codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    weights, from_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        rank = np.argsort(merged, kind="stable")
        weights = merged[rank]
        from_leaf.append(rank < len(leaves))
    take = 2 * len(leaves) - 2
    for level in reversed(from_leaf):
        mine = int(level[:take].sum())
        lengths[order[:mine]] += 1
        take = 2 * (take - mine)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        bits = lengths[order].astype(np.int64)
        # In units of the longest code, codes follow each other without gaps.
        steps = np.int64(1) << (bits.max() - bits)
        codes[order] = (np.concatenate([[0], np.cumsum(steps)[:-1]]) >> (bits.max() - bits)).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length of every possible next ``width`` bits."""
    width = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    times = 1 << (width - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    filled = int(times.sum())
    ids[:filled] = np.repeat(order, times)
    bits[:filled] = np.repeat(lengths[order], times)
    return ids, bits, width


def encode(documents: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All payload bytes, bytes of each document, checkpoints of each document (bits from its start)."""
    n = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.int64)
    bits = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    of = np.concatenate([[0], np.cumsum(n)])
    doc_bytes = (ends[of[1:]] - ends[of[:-1]] + 7) // 8
    base = np.concatenate([[0], np.cumsum(doc_bytes)])
    start = ends[:-1] - np.repeat(ends[of[:-1]], n)
    at = start + np.repeat(base[:-1] * 8, n)
    first = at >> 3
    # A code of 18 bits at most lies within four bytes; bits never overlap, so sums are unions.
    window = codes[ids].astype(np.uint64) << (32 - bits - (at & 7)).astype(np.uint64)
    total = np.zeros(int(base[-1]) + 4, np.float64)
    for k in range(4):
        total += np.bincount(first + k, ((window >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), len(total))
    return total[: int(base[-1])].astype(np.uint8), doc_bytes, [start[a:b:STRIDE] for a, b in zip(of[:-1], of[1:], strict=True)]


def decode(payload: np.ndarray, checkpoints: np.ndarray, runs: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of all runs; each starts at its checkpoint (bits) and has ``runs`` ids, ``STRIDE`` at most. All runs go
    ahead together, one table look-up each at a time."""
    ids, bits, width = table
    padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    starts = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(starts[-1]), np.uint32)
    order = np.argsort(-runs, kind="stable")
    position, first, left = checkpoints[order].astype(np.int64), starts[:-1][order], runs[order]
    active = len(order)
    for step in range(int(runs.max(initial=0))):
        active = int(np.searchsorted(-left[:active], -step))
        here = position[:active]
        peek = (words[here >> 3] >> (32 - width - (here & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        out[first[:active] + step] = ids[peek]
        position[:active] += bits[peek]
    return out


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of every document in rising ``doc_id`` order (null first). Null and empty texts are the end
    id alone; rows that repeat an id are kept, side by side."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "huffman")
    kept = scratch.keep(_encoded(docs, tokenizer, end_id), "ids")
    # One row for each id of the vocabulary.
    found = kept.where(F.col("seen").isNotNull()).select(F.inline("seen")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((row["id"] for row in found), default=0) + 1, np.int64)
    for row in found:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id bigint, bits int")
    book.coalesce(1).write.parquet(f"{folder}/codebook")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            documents = [_from_planes(x) for x in batch.column("planes").to_pylist()]
            payload, sizes, points = encode(documents, codes, lengths)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            whole = payload.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(d) for d in documents], pa.int64()),
                    pa.array([whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([p.astype("<u8").tobytes() for p in points], pa.binary()),
                ],
                names=["doc_id", "n", "code", "points"],
            )

    documents = kept.where(F.col("planes").isNotNull()).select("doc_id", "planes")
    rows = documents.mapInArrow(coded, "doc_id bigint, n bigint, code binary, points binary")
    # Ranges of ids come from the ids alone; asking the coded rows for them would code everything twice.
    parts = tasks_of(spark)
    steps = documents.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (10 * parts)) if parts > 1 else []
    below = F.filter(F.array(*[F.lit(b) for b in sorted(set(steps))]).cast("array<double>"), lambda b: b < F.col("doc_id").cast("double"))
    placed = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(below)).cast("int"))
    ordered = placed.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "n", "code")
    ordered.mapInArrow(_blocks, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop("ids")


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id``, ``planes`` of every document; then, once a task, how often it has ``seen`` each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch, ids in encoded(batches, tokenizer, end_id):
            here = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
            longer, shorter = (seen, here) if len(seen) > len(here) else (here, seen)
            longer[: len(shorter)] += shorter
            seen = longer
            columns = [batch.column("doc_id"), pa.array(map(_planes, ids), pa.binary()), pa.nulls(batch.num_rows, _SEEN)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "planes", "seen"])
        used = np.flatnonzero(seen)
        rows = [{"id": i, "n": n} for i, n in zip(used.tolist(), seen[used].tolist(), strict=True)]
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([rows], _SEEN)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "planes", "seen"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return narrow.mapInArrow(run, "doc_id bigint, planes binary, seen array<struct<id:bigint,n:bigint>>")


_SEEN = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def _planes(ids: bytes) -> bytes:
    """How many ids, then the low bytes of all, then the higher ones: compresses better than ids side by side."""
    each = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    small = not each[:, 2:].any()
    return np.uint32(len(each)).tobytes() + each.T[: 2 if small else 4].tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    planes = np.frombuffer(data, np.uint8, offset=4).reshape(-1, n) if n else np.zeros((2, 0), np.uint8)
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        ids |= plane.astype(np.uint32) << np.uint32(8 * k)
    return ids


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, start = -1, 0, 0
    held: list[tuple] = []
    n = 0

    def close() -> pa.RecordBatch:
        base, points = 0, []
        for _, _, code, own, _ in held:
            points.append(np.frombuffer(own, "<u8") + np.uint64(base * 8))
            base += len(code)
        row = {
            "part": part, "block": block, "start": start, "n_ids": n, "payload": b"".join(x[2] for x in held),
            "doc_ids": [x[0] for x in held], "doc_n_ids": [x[1] for x in held], "doc_bytes": [len(x[2]) for x in held],
            "checkpoints": np.concatenate(points).astype("<u8").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "code", "points", "part")), strict=True):
            if row[4] != part:
                if held:
                    yield close()
                part, block, start, held, n = row[4], 0, 0, [], 0
            held.append(row)
            n += row[1]
            if n >= BLOCK_IDS:
                yield close()
                block, start, held, n = block + 1, start + n, [], 0
    if held:
        yield close()


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_n_ids", pa.list_(pa.int64())), ("doc_bytes", pa.list_(pa.int64())), ("checkpoints", pa.binary()),
    ]
)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (binary: little-endian unsigned
    32-bit), decoded block by block."""
    lengths_of = spark.read.schema("id bigint, bits int").parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((row["id"] for row in lengths_of), default=0) + 1, np.uint8)
    for row in lengths_of:
        lengths[row["id"]] = row["bits"]
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    # One row for each writing task, whose number the cluster sets.
    sizes = sorted((row["part"], row["n"]) for row in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([part for part, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in slices(batches, 4):
            for row in batch.to_pylist():
                n = np.array(row["doc_n_ids"], np.int64)
                runs_of = (n + STRIDE - 1) // STRIDE
                runs = np.full(int(runs_of.sum()), STRIDE, np.int64)
                last = np.cumsum(runs_of) - 1
                runs[last[n > 0]] = (n[n > 0] - 1) % STRIDE + 1
                ids = decode(np.frombuffer(row["payload"], np.uint8), np.frombuffer(row["checkpoints"], "<u8"), runs, table)
                cuts = np.concatenate([[0], np.cumsum(n)])
                whole = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(before[row["part"]] + row["start"] + cuts[:-1], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([whole[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def delete_corpus(spark: SparkSession, folder: str) -> None:
    remove(spark, folder)
