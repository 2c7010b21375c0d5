"""Near-duplicate vectors: iterative quantisation to balanced binary codes, multi-index Hamming tables,
reranking with the original vectors.

Codes are cut into one short piece per table, and vectors that share a piece (and a label) meet. The number
of tables follows from the length of a piece and the chosen miss probability of a pair at the threshold,
measured on pairs made around the vectors that the rotations are learnt from. Where no length of a piece
holds that with ``most`` tables, all vectors of a label and dimension meet.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch, slices, tasks_of, whole_groups
from cinderspark.llm.components import components


@dataclass(frozen=True)
class NearVectors:
    """Rotations are learnt from at most ``fit_rows`` vectors. A piece of the code is as long as it takes for about
    ``meet`` vectors to share it, 8 bits at least; it gets shorter where more than ``most`` tables would be needed.
    Dimensions of ``meet`` vectors or fewer do without codes. Buckets above ``chunk`` vectors are compared chunk by
    chunk. ``probes`` bounds the numbers in the pairs that misses are measured on."""

    cosine: float = 0.98
    fit_rows: int = 8000
    rounds: int = 40
    miss: float = 0.003
    meet: int = 256
    most: int = 64
    probes: int = 4_000_000
    chunk: int = 512
    seed: int = 5


def learn_rotation(x: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Principal axes, then the rotation that alternating sign codes and orthogonal Procrustes arrives at."""
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return axes @ rotation


def usable_vectors(table: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``size`` (components), ``data`` (binary doubles); ``size`` 0 where a vector links with nothing: a
    null vector, id or label, null or non-finite components, length zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, data = [], []
            columns = (batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))
            for vec_id, label, x in zip(*columns, strict=True):
                v = np.array([], float) if vec_id is None or label is None or x is None or None in x else np.array(x, float)
                # Huge or tiny components are brought near 1 by a power of two, which leaves cosines as they are.
                top = float(np.abs(v).max(initial=0))
                good = bool(len(v)) and math.isfinite(top) and top > 0
                if good and not 1e-100 < top < 1e100:
                    v = np.ldexp(v, -math.frexp(top)[1])
                sizes.append(len(v) if good else 0)
                data.append((v + 0.0).astype("<f8").tobytes() if good else b"")
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "size", "data"])

    narrow = table.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return narrow.mapInArrow(run, "vec_id bigint, label string, size int, data binary")


def _unit(data: list[bytes], size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), size)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _tables(bits: int, rules: NearVectors) -> int:
    """Tables by the angle between the vectors themselves: a bit of two vectors differs with probability angle / pi."""
    same = (1 - math.acos(rules.cosine) / math.pi) ** bits
    return math.ceil(math.log(rules.miss) / math.log(1 - same))


def pieces_and_tables(rows: int, rules: NearVectors) -> tuple[int, int]:
    """Bits of a piece, and tables for vectors without a common direction."""
    bits = max(8, math.ceil(math.log2(max(1, rows / rules.meet))))
    return bits, _tables(bits, rules)


def threshold_pairs(x: np.ndarray, mean: np.ndarray, rules: NearVectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of ``x``, others at the threshold from them, and the part each pair counts in: partners lie in any
    direction or towards another vector, and each kind makes five parts by the distance from the mean, as pairs
    near the mean are missed most."""
    rng = np.random.default_rng(rules.seed)
    a = x[rng.permutation(len(x))[: max(rules.meet, rules.probes // (4 * x.shape[1]))]]
    fifth = np.argsort(np.argsort(((a - mean) ** 2).sum(1), kind="stable")) * 5 // len(a)
    b, part = [], []
    for k in range(4):
        anywhere = rng.normal(size=a.shape)
        to = x[rng.integers(len(x), size=len(a))] if k % 2 else anywhere
        for _ in range(2):
            to = to - (to * a).sum(1)[:, None] * a
            length = np.sqrt((to * to).sum(1))[:, None]
            to = np.where(length > 1e-6, to / np.maximum(length, 1e-6), anywhere)
        y = rules.cosine * a + math.sqrt(1 - rules.cosine**2) * (to - (to * a).sum(1)[:, None] * a)
        b.append(y / np.sqrt((y * y).sum(1))[:, None])
        part.append(fifth + 5 * (k % 2))
    return np.concatenate([a] * 4), np.concatenate(b), np.concatenate(part)


def fit_codes(x: np.ndarray, rows: int, rules: NearVectors) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, rotations (``bits`` columns for each table) and ``bits``, learnt from unit vectors ``x`` for ``rows`` vectors: so
    many tables that ``miss`` holds in every part of threshold_pairs. 0 bits: all vectors meet in one table."""
    size = x.shape[1]
    if rows > rules.meet and len(x) > 1:
        mean = x.mean(0)
        a, b, part = threshold_pairs(x, mean, rules)
        of_part = np.maximum(np.bincount(part, minlength=10), 1)
        turns = np.zeros((size, 0))
        for bits in range(pieces_and_tables(rows, rules)[0], 0, -1):
            met = np.zeros(len(a), bool)
            for table in range(rules.most):
                while turns.shape[1] < bits * (table + 1):
                    turns = np.concatenate([turns, learn_rotation(x - mean, rules.rounds, rules.seed + turns.shape[1] // size)], 1)
                piece = turns[:, bits * table : bits * (table + 1)]
                met |= (((a - mean) @ piece >= 0) == ((b - mean) @ piece >= 0)).all(1)
                if table + 1 >= _tables(bits, rules) and (np.bincount(part[~met], minlength=10) <= rules.miss * of_part).all():
                    return mean, turns[:, : bits * (table + 1)], bits
    return np.zeros(size), np.zeros((size, 0)), 0


def with_codes(vectors: DataFrame, rules: NearVectors) -> DataFrame:
    """Add ``codes``: one piece for each table, of which there are as many as the vectors of a dimension need."""
    # One row per dimension.
    of_size = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [size for size, n in of_size.items() if n > rules.meet]
    # The documented bound on what the rotations are learnt from.
    each = max(rules.meet, rules.fit_rows // max(len(large), 1))
    fit = []
    if large:
        shares = F.create_map(*[F.lit(v) for size in large for v in (size, min(1.0, each / of_size[size]))])
        draw = F.pmod(F.xxhash64("data", F.lit(rules.seed)), F.lit(1 << 40)) < shares[F.col("size")] * float(1 << 40)
        fit = vectors.where(draw).select("size", "data").limit(2 * each * len(large)).collect()
    models: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for size, n in of_size.items():
        data = sorted(bytes(r["data"]) for r in fit if r["size"] == size)
        models[size] = fit_codes(_unit(data, size) if data else np.zeros((0, size)), n, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, of = batch.column("data").to_pylist(), batch.column("size").to_numpy()
            tables = np.zeros(batch.num_rows, np.int64)
            pieces = {}
            for size in np.unique(of).tolist():
                here = np.flatnonzero(of == size)
                mean, turns, bits = models[size]
                if bits:
                    signs = (_unit([data[i] for i in here], size) - mean) @ turns >= 0
                    pieces[size] = signs.reshape(len(here), -1, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                else:
                    pieces[size] = np.zeros((len(here), 1), np.int64)
                tables[here] = pieces[size].shape[1]
            begins = np.concatenate([[0], np.cumsum(tables)])
            flat = np.zeros(begins[-1], np.int64)
            for size, codes in pieces.items():
                flat[begins[:-1][of == size][:, None] + np.arange(codes.shape[1])] = codes
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    return vectors.mapInArrow(run, vectors.withColumn("codes", F.array().cast("array<bigint>")).schema)


def _linked(rules: NearVectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            group = table.column("group").to_numpy()
            nodes, weights, table_no, chunk, size = (table.column(c).to_numpy() for c in ("node", "weight", "table", "chunk", "size"))
            i_no, j_no = table.column("i").to_numpy(), table.column("j").to_numpy()
            lists = table.column("codes").combine_chunks()
            begins, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            data = table.column("data").to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            out_node, out_links, out_root = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                x = np.frombuffer(b"".join(data[a:b]), "<f8").reshape(b - a, int(size[a]))
                length = np.sqrt((x * x).sum(1))
                near = (x @ x.T) / (length[:, None] * length[None, :]) >= rules.cosine
                np.fill_diagonal(near, False)
                if i_no[a] != j_no[a]:  # the pairs inside a chunk belong to the group of that chunk
                    near &= chunk[a:b, None] != chunk[None, a:b]
                if not near.any():
                    continue
                codes = flat[begins[a] : begins[b]].reshape(b - a, -1)  # of one dimension
                links = near.copy()
                for t in range(int(table_no[a])):  # counted in an earlier table already
                    links &= codes[:, t][:, None] != codes[:, t][None, :]
                label = np.arange(b - a)
                while True:
                    lower = np.minimum(label, np.where(near, label[None, :], b - a).min(1))
                    if (lower == label).all():
                        break
                    label = lower
                some = np.flatnonzero(near.any(1))
                out_node.append(nodes[a:b][some])
                out_links.append(links[some] @ weights[a:b])
                out_root.append(nodes[a:b][label[some]])
            if out_node:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in (out_node, out_links, out_root)], names=["node", "links", "root"]
                )

    return run


def near_vectors(table: DataFrame, rules: NearVectors = NearVectors()) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``, a row per row.

    Vectors of one label and dimension are compared. Exact copies are one class whose links are counted, not
    listed. Rows that share a vec_id are one node. Unusable rows (see usable_vectors) have no link and stay.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "itq")
    vectors = scratch.keep(usable_vectors(table).withColumn("copy_of", F.md5(F.concat_ws("|", "label", F.hex("data")).cast("binary"))), "vectors")
    used = vectors.where("size > 0")
    classes = used.groupBy("copy_of").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("data").alias("data")
    )
    classes = scratch.keep(classes, "classes")
    coded = scratch.keep(with_codes(classes, rules), "coded")

    piece = F.posexplode("codes").alias("table", "piece")
    keyed = coded.select("node", "weight", "label", "size", "data", "codes", piece)
    keys = ["label", "size", "table", "piece"]
    large = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.chunk)
    large = scratch.keep(large.select(*keys, F.ceil(F.col("n") / rules.chunk).cast("int").alias("chunks")), "large")
    spread = keyed.join(large, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64("node", "table"), F.col("chunks")).cast("int"))
    paired = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns(
        {"i": F.least("chunk", "_other"), "j": F.greatest("chunk", "_other")}
    )
    grouped = paired.withColumn("group", F.xxhash64(*keys, "i", "j")).select(
        "group", "node", "weight", "table", "chunk", "size", "i", "j", "codes", "data"
    )
    dealt = grouped.repartition(tasks_of(spark), "group").sortWithinPartitions("group", "node")
    found = scratch.keep(dealt.mapInArrow(_linked(rules), "node bigint, links bigint, root bigint"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "components")
    results = classes.select("copy_of", "node", "weight").join(links, "node", "left").join(joined, "node", "left")
    results = scratch.keep(
        results.select(
            "copy_of", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
        ),
        "results",
    )
    linked = used.select("vec_id", "copy_of").join(results, "copy_of").select("vec_id", "n_links", "component_id")
    alone = vectors.where("size = 0").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    same = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).withColumn("kept", same)
