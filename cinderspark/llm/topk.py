"""Exact top-k inner products by buckets of vectors of similar length.

Vectors are laid out by falling length and cut into buckets. A query's k-th best score over the first bucket
is its bound; a bucket then has a local cosine threshold for it: bound / (query length * greatest length in
the bucket). Above 1 the bucket and all after it are out. Where it is high, few vectors are left by the
interval that Cauchy-Schwarz allows to the query's largest coordinates (coordinate pruning); where it is
low, vectors are cut by length alone. What is left is multiplied out.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.llm.common import Scratch, slices, tasks_of

# Whole numbers up to this are exact in doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class TopK:
    """``coordinate_from`` is the local cosine threshold above which ``focus`` coordinates are looked at."""

    k: int = 10
    scale: int = 1024
    every: int = 100
    bucket: int = 1024
    queries: int = 512
    focus: int = 4
    coordinate_from: float = 0.5


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """``vec_id``, ``length``, ``data`` (binary: 64-bit whole numbers floor(scale * x)) of the vectors that take part:
    those with an id, not null, all components finite (and within 64 bits when scaled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, lengths, data = [], [], []
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is None or x is None or None in x:
                    continue
                v = np.floor(np.array(x, np.float64) * scale)
                if not np.isfinite(v).all() or (np.abs(v) >= 2.0**63).any():
                    continue
                ids.append(vec_id)
                lengths.append(float(np.sqrt((v * v).sum())))
                data.append(v.astype("<i8").tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.float64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "length", "data"])

    narrow = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return narrow.mapInArrow(run, "vec_id bigint, length double, data binary")


def _packed(rows: int):
    """Runs of at most ``rows`` vectors of one dimension, longest first, as one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            columns = [
                pa.array([part * (1 << 32) + number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([held[0][1]], pa.float64()),
                pa.array([np.array([x[0] for x in held], "<i8").tobytes()], pa.binary()),
                pa.array([np.array([x[1] for x in held], "<f8").tobytes()], pa.binary()),
                pa.array([b"".join(x[2] for x in held)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "longest", "ids", "lengths", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "length", "data")), strict=True):
                if held and (len(held) == rows or len(row[2]) != len(held[0][2])):
                    yield close()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield close()

    return run


_PACKED = "bucket bigint, n bigint, longest double, ids binary, lengths binary, data binary"


def _block(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, lengths = np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}lengths"], "<f8")
    return ids, lengths, np.frombuffer(row[f"{side}data"], "<i8").reshape(len(ids), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum is a whole number they hold, else in Python's."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ v.T
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    other = ids != query
    ids, scores = ids[other], scores[other]
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return [(query, int(ids[i]), int(scores[i])) for i in order]


def candidates(query: np.ndarray, size: float, bound: float, unit: np.ndarray, lengths: np.ndarray, rules: TopK) -> np.ndarray:
    """Rows of a bucket (unit vectors and their lengths) that can reach ``bound`` with a query of length ``size``."""
    if bound == -np.inf or not len(lengths):
        return np.arange(len(lengths))
    # Half a unit and a relative slack cover the rounding of lengths and products.
    bound = bound - 0.5 - 1e-9 * abs(bound)
    if bound <= 0:
        return np.arange(len(lengths))
    alive = np.flatnonzero(lengths * size >= bound)
    if not len(alive) or size == 0:
        return alive
    local = bound / (size * lengths[alive[0]])
    if local < rules.coordinate_from:
        return alive
    direction = query / size
    spread = max(0.0, 1 - min(1.0, local) ** 2)
    for c in np.argsort(-np.abs(direction), kind="stable")[: rules.focus]:
        middle, reach = direction[c] * local, np.sqrt(max(0.0, 1 - direction[c] ** 2) * spread) + 1e-6
        # A larger cosine only narrows this on the far side, so the open side stays open.
        x = unit[alive, c]
        alive = alive[x >= middle - reach] if direction[c] > 0 else alive[x <= middle + reach]
    return alive


def exact_top_k(table: DataFrame, rules: TopK = TopK()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of every row whose ``vec_id`` is divisible by ``every`` against all
    others; ties to the smaller vec_id.

    Vectors with a null id, null or non-finite components take no part. Vectors of another dimension than a
    query's are no candidates. Rows that repeat a vec_id are candidates of their own, except for that query.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.keep(whole_vectors(table, rules.scale), "vectors")
    laid = vectors.repartitionByRange(tasks_of(spark), F.desc("length")).sortWithinPartitions(F.desc("length"), "vec_id")
    buckets = scratch.keep(laid.mapInArrow(_packed(rules.bucket), _PACKED), "buckets")
    asked = vectors.where(F.pmod("vec_id", F.lit(rules.every)) == 0).dropDuplicates(["vec_id", "data"])
    asked = asked.repartitionByRange(tasks_of(spark), F.desc("length")).sortWithinPartitions(F.desc("length"), "vec_id")
    queries = scratch.keep(asked.mapInArrow(_packed(rules.queries), _PACKED).withColumnRenamed("bucket", "block"), "queries")

    # The first bucket is one row of at most ``bucket`` vectors.
    first = buckets.orderBy(F.desc("longest"), "bucket").limit(1).collect()
    head = _block(first[0].asDict()) if first else None

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            bounds = []
            for row in batch.to_pylist():
                ids, _, q = _block(row)
                bound = np.full(len(ids), -np.inf)
                if head is not None and head[2].shape[1] == q.shape[1]:
                    scores = products(q, head[2]).astype(np.float64)
                    scores[ids[:, None] == head[0][None, :]] = -np.inf
                    if scores.shape[1] >= rules.k:
                        bound = -np.partition(-scores, rules.k - 1, 1)[:, rules.k - 1]
                bounds.append(bound)
            # A block goes to a bucket while its easiest query can: bound / length of the query.
            with np.errstate(divide="ignore", invalid="ignore"):
                needs = [
                    float(np.min(np.where(b <= 0, 0.0, b / _block(r)[1]), initial=np.inf)) for b, r in zip(bounds, batch.to_pylist(), strict=True)
                ]
            columns = [*batch.columns, pa.array([b.astype("<f8").tobytes() for b in bounds], pa.binary()), pa.array(needs, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "bounds", "needs"])

    ready = queries.mapInArrow(bounded, _PACKED.replace("bucket", "block") + ", bounds binary, needs double")
    ready = scratch.keep(ready, "ready", rows=8)
    # Blocks of queries against buckets of vectors: which meet is settled on their bounds, before data move.
    near = F.col("longest") * (1 + 1e-9) + 1 >= F.col("needs")
    meet = scratch.keep(ready.select("block", "needs").join(buckets.select("bucket", "longest"), near).select("block", "bucket"), "meet")
    q_side = ready.select("block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "lengths", "data", "bounds")])
    joined = meet.join(q_side, "block").join(buckets.select("bucket", "ids", "lengths", "data"), "bucket")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids, lengths, v = _block(row)
            q_ids, sizes, q = _block(row, "q_")
            if q.shape[1] != v.shape[1]:
                continue
            bounds = np.frombuffer(row["q_bounds"], "<f8")
            unit = v / np.where(lengths > 0, lengths, 1.0)[:, None]
            left = [candidates(x.astype(np.float64), s, b, unit, lengths, rules) for x, s, b in zip(q, sizes, bounds, strict=True)]
            full = [i for i, c in enumerate(left) if len(c) > len(lengths) // 4]
            out = []
            if full:
                for i, scores in zip(full, products(q[full], v), strict=True):
                    out += _best(int(q_ids[i]), ids[left[i]], scores[left[i]], rules.k)
            for i in set(range(len(left))) - set(full):
                if len(left[i]):
                    out += _best(int(q_ids[i]), ids[left[i]], products(q[i : i + 1], v[left[i]])[0], rules.k)
            columns = [pa.array([x[c] for x in out], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    found = scratch.keep(joined.mapInArrow(multiplied, "query_id bigint, vec_id bigint, score bigint"), "found", rows=8)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rules.k).select("query_id", "rank", "vec_id", "score")
