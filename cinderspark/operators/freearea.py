"""The part of a box that may be far from every target, as numbered cells to draw places from.

The box is split into cells no wider than the radius. Cells wholly within the radius of a target are dropped, cells wholly
beyond every radius are kept whole, and only cells that are cut are split further, in four, down to ``depth``. What is left
is numbered in finest cells along a space-filling curve, so that one uniform number names a finest cell of
the free area, however small a share of the box that is.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.functions.grid import KM_PER_DEGREE
from cinderspark.operators.skew import default_buckets, running_totals
from cinderspark.params import Box
from cinderspark.session import cut_lineage

# Targets stand for the cell they lie in, whose side is the radius / 2 ** TARGET_BITS: so many to a cell of radius size
# at most, however many targets share a place.
TARGET_BITS = 5
# Halvings of a cell of radius size, at first and at most. Room that is narrower than the last finest cell counts as none.
DEPTH, MAX_DEPTH = 3, 10
# Distances are worked out in floating point; a cell is called inside or outside only beyond this slack, in degrees.
SLACK = 1e-9
# Leaves that may be sent to every task.
SENT_LEAVES = 500_000


@dataclass(frozen=True)
class FreeArea:
    """``leaves``: ``code`` (of a leaf's first finest cell on the curve), ``count`` (finest cells), ``before`` (those of all leaves
    before), ``cut`` (whether a radius may cut it). ``total``: finest cells of all leaves; the others say where they are."""

    leaves: DataFrame
    total: int
    depth: int
    columns: int
    south: float
    west: float
    height: float
    width: float

    def place(self, code: Column, up: Column, right: Column) -> tuple[Column, Column]:
        """Latitude and longitude of the place ``up``, ``right`` (shares of 1) in the finest cell ``code``."""
        coarse = F.shiftright(code, 2 * self.depth)
        i, j = F.floor(coarse / self.columns).cast("bigint"), coarse % self.columns
        for bit in reversed(range(self.depth)):
            i = i * 2 + F.shiftright(code, 2 * bit + 1).bitwiseAND(F.lit(1))
            j = j * 2 + F.shiftright(code, 2 * bit).bitwiseAND(F.lit(1))
        return F.lit(self.south) + (i + up) * F.lit(self.height), F.lit(self.west) + (j + right) * F.lit(self.width)


def _target_cells(targets: DataFrame, radius: float, bits: int) -> DataFrame:
    """(``_ti``, ``_tj``, ``_cells``): occupied cells of radius / 2 ** bits in each cell of radius size, at most 4 ** bits of them."""
    side = radius / 2**bits
    fine = targets.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.floor(F.col("lat") / F.lit(side)).cast("bigint").alias("a"), F.floor(F.col("lon") / F.lit(side)).cast("bigint").alias("b")
    )
    keyed = fine.distinct().withColumns({"_ti": F.shiftright("a", bits), "_tj": F.shiftright("b", bits)})
    return keyed.groupBy("_ti", "_tj").agg(F.collect_list(F.struct("a", "b")).alias("_cells"))


def _classified(cells: DataFrame, targets: DataFrame, radius: float, side: float) -> DataFrame:
    """Add ``near`` and ``far``: no target is nearer to any place of the cell than ``near``, and some target is nearer to all
    its places than ``far`` (null: no target within reach)."""
    reach = lambda low, high: F.sequence(F.floor((low - radius) / radius).cast("bigint"), F.floor((high + radius) / radius).cast("bigint"))
    around = cells.withColumn("_ti", F.explode(reach(F.col("_s"), F.col("_n")))).withColumn("_tj", F.explode(reach(F.col("_w"), F.col("_e"))))

    def span(low: Column, high: Column, at: Column) -> tuple[Column, Column]:
        first, last = at * F.lit(side), (at + 1) * F.lit(side)
        return F.greatest(F.lit(0.0), first - high, low - last), F.greatest(high - first, last - low)

    def distances(cell: Column) -> tuple[Column, Column]:
        (near_i, far_i), (near_j, far_j) = span(F.col("_s"), F.col("_n"), cell["a"]), span(F.col("_w"), F.col("_e"), cell["b"])
        return F.sqrt(near_i * near_i + near_j * near_j), F.sqrt(far_i * far_i + far_j * far_j)

    met = around.join(targets, ["_ti", "_tj"]).select(
        "_i", "_j", F.array_min(F.transform("_cells", lambda c: distances(c)[0])).alias("near"), F.array_min(F.transform("_cells", lambda c: distances(c)[1])).alias("far")
    )
    return cells.join(met.groupBy("_i", "_j").agg(F.min("near").alias("near"), F.min("far").alias("far")), ["_i", "_j"], "left")


def free_area(spark: SparkSession, targets: DataFrame, km: float, box: Box, depth: int = DEPTH, bits: int = TARGET_BITS) -> FreeArea:
    """What of ``box`` is not within ``km`` (planar) of a target as far as cells tell. ``total`` 0 means there is no room."""
    radius = km / KM_PER_DEGREE
    rows, columns = (max(1, math.ceil((b - a) / radius)) for a, b in ((box.south, box.north), (box.west, box.east)))
    height, width = (box.north - box.south) / (rows * 2**depth), (box.east - box.west) / (columns * 2**depth)
    occupied = cut_lineage(_target_cells(targets, radius, bits))
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("bigint").alias("_i"), (F.col("id") % columns).alias("_j"), F.shiftleft("id", 2 * depth).alias("code"))
    leaves = None
    for level in range(depth + 1):
        finest = 2 ** (depth - level)
        edges = {
            "_s": F.lit(box.south) + F.col("_i") * finest * F.lit(height), "_n": F.lit(box.south) + (F.col("_i") + 1) * finest * F.lit(height),
            "_w": F.lit(box.west) + F.col("_j") * finest * F.lit(width), "_e": F.lit(box.west) + (F.col("_j") + 1) * finest * F.lit(width),
        }
        known = cut_lineage(_classified(cells.withColumns(edges), occupied, radius, radius / 2**bits))
        kept = known.where(F.col("far").isNull() | (F.col("far") >= radius - SLACK))
        cut = F.coalesce(F.col("near") < radius + SLACK, F.lit(False))
        done = kept if level == depth else kept.where(~cut)
        these = done.select("code", F.lit(finest * finest).cast("bigint").alias("count"), cut.alias("cut"))
        leaves = these if leaves is None else leaves.unionByName(these)
        quarter = kept.where(cut).withColumn("_q", F.explode(F.array(*[F.lit(q) for q in range(4)])))
        cells = quarter.select(
            (F.col("_i") * 2 + F.shiftright("_q", 1)).alias("_i"), (F.col("_j") * 2 + F.col("_q") % 2).alias("_j"),
            (F.col("code") + F.col("_q") * (finest * finest // 4)).alias("code"),
        )
    top = float(rows * columns * 4**depth)
    buckets = default_buckets(leaves)
    splits = [float("-inf"), *[top * k / buckets for k in range(1, buckets)], float("inf")]
    ordered = running_totals(leaves.withColumn("_order", F.col("code").cast("double")), "_order", {"_upto": "count"}, None, ["code"], splits)
    numbered = cut_lineage(ordered.select("code", "count", "cut", (F.col("_upto") - F.col("count")).alias("before")))
    total = numbered.agg(F.sum("count")).first()[0] or 0
    return FreeArea(numbered, total, depth, columns, box.south, box.west, height, width)


def drawn_places(ids: DataFrame, area: FreeArea, leaf: Column, up: Column, right: Column) -> DataFrame:
    """``ids`` with ``lat``, ``lon`` and ``cut``: the finest cell at the share ``leaf`` of the free area, and the place in it. Draws meet
    leaves by blocks of numbers; a leaf stands in the blocks it covers, which are as many as there are leaves. Up to
    ``SENT_LEAVES`` leaves, whose number follows from box and radius, go to the draws, so that draws stay where they are."""
    n_leaves = max(area.leaves.count(), 1)
    block = max(1, -(-area.total // n_leaves))
    blocks = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("count") - 1) / block))
    spread = area.leaves.select("code", "before", "count", "cut", F.explode(blocks).alias("_block"))
    asked = ids.withColumn("_k", F.floor(leaf * F.lit(float(area.total))).cast("bigint")).withColumn("_block", F.floor(F.col("_k") / block))
    here = (F.col("_k") >= F.col("before")) & (F.col("_k") < F.col("before") + F.col("count"))
    met = asked.join(F.broadcast(spread) if n_leaves <= SENT_LEAVES else spread, "_block").where(here)
    lat, lon = area.place(F.col("code") + F.col("_k") - F.col("before"), up, right)
    return met.select(*ids.columns, lat.alias("lat"), lon.alias("lon"), "cut")
