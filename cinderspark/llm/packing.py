"""Best-fit packing planned on the histogram of lengths.

At most ``capacity`` different lengths exist, so the plan works on counts: bins that look alike are one run
of sequence numbers, and a length is put into the tightest run that takes it. Pieces then learn their rank
among pieces of their length and find the slot planned for that rank.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.llm.common import Scratch, tasks_of
from cinderspark.llm.tokens import encoded, texts_of

# Rows of one length that a task should rank.
RANK_ROWS = 200_000


@dataclass(frozen=True)
class Slots:
    """Ranks [low, high) of a length: ``each`` of them to a sequence, from ``first`` on, starting at ``offset``."""

    length: int
    low: int
    high: int
    each: int
    first: int
    offset: int


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[Slots]:
    """Best-fit-decreasing over counts. A run of bins is touched at most log2(capacity) times, because what
    is left in a bin at least halves, so the plan has O(capacity * log capacity) rows whatever the counts."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first sequence, number of sequences)
    plan: list[Slots] = []
    sequences = 0

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit into {capacity}")
        rank, left = 0, counts[length]
        tightest = sorted(room for room in runs if room >= length)
        while left:
            if tightest:
                room = tightest.pop(0)
                bins = runs.pop(room)
            else:
                room, bins = capacity, [(sequences, -(-left // (capacity // length)))]
                sequences += bins[0][1]
            each = room // length
            while bins and left:
                first, n = bins.pop()
                full = min(n, left // each)
                if full:
                    plan.append(Slots(length, rank, rank + full * each, each, first, capacity - room))
                    runs.setdefault(room - each * length, []).append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < n and left:
                    plan.append(Slots(length, rank, rank + left, left, first + full, capacity - room))
                    runs.setdefault(room - left * length, []).append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    bins.append((first + full, n - full))
            if bins:
                runs.setdefault(room, []).extend(bins)
    return plan


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keys``, ``piece``, ``start``, ``length``, ``ids``: documents longer than ``capacity`` tokens are cut, the
    first piece taking what is left over. Null and empty texts are the end id alone. One Python stage encodes and cuts, as
    each stage of a task keeps a worker of its own."""
    narrow = texts_of(docs, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer, end_id):
            rows, piece, start, length, parts = [], [], [], [], []
            for row, data in enumerate(ids):
                n = len(data) // 4
                begin, end = 0, n % capacity or capacity
                number = 0
                while begin < n:
                    rows.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(end - begin)
                    parts.append(data[4 * begin : 4 * end])
                    begin, end, number = end, end + capacity, number + 1
            of = pa.array(rows, pa.int32())
            columns = [batch.column(k).take(of) for k in keys]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "piece", "start", "length", "ids"])

    schema = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(run, f"{schema}, piece int, start bigint, length bigint, ids binary")


def place(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``.

    ``pieces`` is read three times and should be a written table. Rows are ranked within (length, salt), so
    that a length that most pieces share is spread over tasks; ranks start at the count of the salts before.
    Equal rows take separate slots. The plan, whose size only ``capacity`` bounds, is the one broadcast.
    """
    spark = pieces.sparkSession
    # One row for each length, at most ``capacity``.
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    salts = max(tasks_of(spark), -(-rows // RANK_ROWS))
    slots = spark.createDataFrame(
        [(s.length, s.low, s.high, s.each, s.first, s.offset) for s in best_fit_plan(counts, capacity)],
        "_length bigint, _low bigint, _high bigint, _each bigint, _first bigint, _offset bigint",
    )
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = (
        salted.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
    )
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    turn = F.col("_rank") - F.col("_low")
    return ranked.join(F.broadcast(slots), here).select(
        *pieces.columns,
        (F.col("_first") + F.floor(turn / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + turn % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_tokens``, ``ids``, ``doc_ids``, ``offsets``. A sequence holds at most
    ``capacity`` tokens, which bounds every group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts"), F.sum("length").alias("n_tokens")).select(
        "sequence_id",
        "n_tokens",
        F.aggregate("_parts", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"),
        F.col("_parts.doc_id").alias("doc_ids"),
        F.col("_parts.offset").alias("offsets"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its place, and ``ids_crc32`` of its ids."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(scratch.keep(narrow, "pieces"), capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The sequences themselves, ready to be written for training."""
    scratch = Scratch(docs.sparkSession, "packing")
    return sequences(place(scratch.keep(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity))
