"""Joins by place: raster samples, exclusion radius, nearest target, tile coverage."""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.functions.grid import KM_PER_DEGREE, matching_boxes
from cinderspark.operators.boxtree import BoxTree
from cinderspark.operators.skew import lookup
from cinderspark.session import cut_lineage

# Places of a leaf of the place index, most leaves (they are sent to every task), and points of a leaf searched at once.
LEAF_PLACES = 4096
MAX_LEAVES = 4096
CHUNK = 50_000
CURVE_BITS = 24


def sample_cells(points: DataFrame, cells: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Value of each point's cell (and day); NULL where the table has none."""
    return lookup(points, cells.select(*on, *values), on)


def _ordered(lat: np.ndarray, lon: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Number of each place along a curve through a box, halving it by turns."""
    code = np.zeros(len(lat), np.int64)
    for shift, values, low, high in ((1, lat, box[0], box[2]), (0, lon, box[1], box[3])):
        cells = np.clip((values - low) / max(high - low, 1e-9) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
        for bit in range(CURVE_BITS):
            code |= ((cells >> bit) & 1) << (2 * bit + shift)
    return code


@dataclass(frozen=True)
class PlaceIndex:
    """The distinct places of targets in ranges of a curve: ``places`` (_leaf, _tlat, _tlon), written once, and the ``boxes``
    around the ranges (south, west, north, east), at most ``MAX_LEAVES`` rows."""

    places: DataFrame
    boxes: np.ndarray


def place_index(targets: DataFrame, lat: str = "lat", lon: str = "lon", limit: int = LEAF_PLACES) -> PlaceIndex | None:
    """Index of the targets' places, or nothing if no target has one. A leaf holds about ``limit`` places, or one in
    ``MAX_LEAVES`` of them all where that is more."""
    named = targets.select(F.col(lat).cast("double").alias("_tlat"), F.col(lon).cast("double").alias("_tlon"))
    somewhere = F.col("_tlat") + F.col("_tlon")
    places = cut_lineage(named.where(somewhere.isNotNull() & ~F.isnan(somewhere)).distinct())
    n, *box = places.agg(F.count(F.lit(1)), F.min("_tlat"), F.min("_tlon"), F.max("_tlat"), F.max("_tlon")).first()
    if not n:
        return None

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _ordered(batch.column("_tlat").to_numpy(), batch.column("_tlon").to_numpy(), tuple(box))
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], names=["_code", "_tlat", "_tlon"])

    on_curve = places.mapInArrow(coded, "_code bigint, _tlat double, _tlon double")
    leaves = max(1, min(MAX_LEAVES, math.ceil(n / limit)))
    cuts = sorted(set(on_curve.approxQuantile("_code", [i / leaves for i in range(1, leaves)], 0.1 / leaves))) if leaves > 1 else []
    edges = np.array(cuts, np.float64).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.searchsorted(edges, batch.column("_code").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns[1:]], names=["_leaf", "_tlat", "_tlon"])

    laid = cut_lineage(on_curve.mapInArrow(placed, "_leaf int, _tlat double, _tlon double"))
    # At most MAX_LEAVES rows.
    hulls = laid.groupBy("_leaf").agg(F.min("_tlat"), F.min("_tlon"), F.max("_tlat"), F.max("_tlon")).collect()
    boxes = np.full((leaves, 4), np.inf)
    for hull in hulls:
        boxes[hull[0]] = hull[1:]
    return PlaceIndex(laid, boxes)


def _searched(points: DataFrame, index: PlaceIndex, radius: float | None, search: Callable, schema: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows that ``search(ids, lat, lon, tree)`` gives for the points of a leaf that needs to be looked into, and the rows
    (_id, _lat, _lon) that need no look: settled by a whole box or, without a radius, without a place.

    Points are dealt to the leaves that can matter to them. Leaves with more than ``chunk`` points are split, each part
    with a copy of the leaf's places, so that no leaf, hot place or id makes a large task.
    """
    kept = np.flatnonzero(np.isfinite(index.boxes[:, 0]))
    boxes = index.boxes[kept]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, row = BoxTree(boxes), 0
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_lat", "_lon"))
            for place, item, settled in tree.candidates(lat, lon, radius):
                if radius is None:
                    settled = np.array([], np.int64)
                take = np.concatenate([place, settled])
                leaf = np.concatenate([kept[item], np.full(len(settled), -1)]).astype(np.int32)
                part = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf), pa.array(np.arange(row, row + len(take)))], names=[*part.schema.names, "_leaf", "_row"])
                row += len(take)
            if radius is None and (missing := np.flatnonzero(np.isnan(lat + lon))).size:
                part = batch.take(pa.array(missing))
                leaf, zero = pa.array(np.full(len(missing), -1, np.int32)), pa.array(np.zeros(len(missing), np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, leaf, zero], names=[*part.schema.names, "_leaf", "_row"])

    kind = points.schema["_id"].dataType.simpleString()
    dealt = cut_lineage(points.mapInArrow(asked, f"_id {kind}, _lat double, _lon double, _leaf int, _row bigint"))
    inside, outside = dealt.where("_leaf >= 0"), dealt.where("_leaf < 0").select("_id", "_lat", "_lon")
    # Leaves: at most MAX_LEAVES rows.
    parts = F.broadcast(inside.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_parts")))
    split = inside.join(parts, "_leaf").withColumn("_part", F.pmod("_row", "_parts").cast("int"))
    copied = index.places.join(parts, "_leaf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        y, x = (right.column(c).to_numpy() for c in ("_tlat", "_tlon"))
        lat, lon = (left.column(c).to_numpy() for c in ("_lat", "_lon"))
        return search(left.column("_id"), lat, lon, BoxTree(np.column_stack([y, x, y, x])))

    grouped = split.select("_leaf", "_part", "_id", "_lat", "_lon").groupBy("_leaf", "_part")
    found = grouped.cogroup(copied.select("_leaf", "_part", "_tlat", "_tlon").groupBy("_leaf", "_part")).applyInArrow(within, schema.format(kind=kind))
    return found, outside


def _kilometres(lat: np.ndarray, lon: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    dlat, dlon = lat - boxes[:, 0], lon - boxes[:, 1]
    return np.sqrt(dlat * dlat + dlon * dlon) * KM_PER_DEGREE


def _asking(points: DataFrame, pid: str, lat: str, lon: str) -> DataFrame:
    return points.select(F.col(pid).alias("_id"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))


def near_ids(
    points: DataFrame, targets: DataFrame, km: float, pid: str = "pid", lat: str = "lat", lon: str = "lon", limit: int = LEAF_PLACES, chunk: int = CHUNK
) -> DataFrame:
    """Distinct ids of points closer than ``km`` (planar) to any target.

    Points with a whole leaf of targets inside their radius are settled by the boxes of the leaves; the others go, in one
    shuffle, to the leaves that their radius cuts, and are searched there by a tree. Points and targets without a
    place are near nothing.
    """
    asking = _asking(points, pid, lat, lon)
    index = place_index(targets, lat, lon, limit)
    if index is None:
        return asking.limit(0).select(F.col("_id").alias(pid))
    radius = km / KM_PER_DEGREE

    def search(ids: pa.ChunkedArray, y: np.ndarray, x: np.ndarray, tree: BoxTree) -> pa.Table:
        hit = np.zeros(len(ids), bool)
        for place, item, settled in tree.candidates(y, x, radius):
            hit[settled] = True
            hit[place[_kilometres(y[place], x[place], tree.boxes[item]) < km]] = True
        return pa.table({"_id": ids.filter(pa.array(hit))})

    found, settled = _searched(asking, index, radius, search, "_id {kind}", chunk)
    return found.unionByName(settled.select("_id")).distinct().withColumnRenamed("_id", pid)


def exclude_near(
    points: DataFrame, targets: DataFrame, km: float, pid: str = "pid", lat: str = "lat", lon: str = "lon", limit: int = LEAF_PLACES, chunk: int = CHUNK
) -> DataFrame:
    """Points that are at least ``km`` from every target."""
    return points.join(near_ids(points, targets, km, pid, lat, lon, limit, chunk), pid, "left_anti")


def nearest_km(
    points: DataFrame, targets: DataFrame, pid: str = "pid", lat: str = "lat", lon: str = "lon", limit: int = LEAF_PLACES, chunk: int = CHUNK
) -> DataFrame:
    """(pid, nearest_km): exact planar distance to the nearest target; NULL without a target or a place.

    The boxes of the leaves bound each point's distance; it goes, in one shuffle, to the leaves that can hold its
    nearest target and is searched there by a tree.
    """
    asking = _asking(points, pid, lat, lon)
    index = place_index(targets, lat, lon, limit)
    if index is None:
        return points.select(F.col(pid), F.lit(None).cast("double").alias("nearest_km"))

    def search(ids: pa.ChunkedArray, y: np.ndarray, x: np.ndarray, tree: BoxTree) -> pa.Table:
        least = np.full(len(ids), np.inf)
        for place, item, _ in tree.candidates(y, x):
            np.minimum.at(least, place, _kilometres(y[place], x[place], tree.boxes[item]))
        return pa.table({"_id": ids, "nearest_km": least})

    found, placeless = _searched(asking, index, None, search, "_id {kind}, nearest_km double", chunk)
    every = found.unionByName(placeless.select("_id", F.lit(None).cast("double").alias("nearest_km")))
    return every.groupBy("_id").agg(F.min("nearest_km").alias("nearest_km")).withColumnRenamed("_id", pid)


def tile_memberships(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per point and tile box that holds it."""
    return points.withColumn("tile", F.explode(matching_boxes(F.col(lat), F.col(lon))))


def first_tile(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The first tile box, in lookup order, that holds the point; NULL if none does."""
    return points.withColumn("tile", F.get(matching_boxes(F.col(lat), F.col(lon)), F.lit(0)))


def unmatched(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points in no tile box."""
    return points.where(F.size(matching_boxes(F.col(lat), F.col(lon))) == 0)


def missing_tiles(points: DataFrame, available: DataFrame, tile: str = "tile") -> DataFrame:
    """Tiles that points need and ``available`` lacks, with how many points and which share of all."""
    counts = points.groupBy(tile).agg(F.count(F.lit(1)).alias("n_points"))
    shared = counts.withColumn("pct", F.col("n_points") * 100.0 / F.sum("n_points").over(Window.partitionBy()))
    return shared.join(available.select(tile).distinct(), tile, "left_anti")


def coverage_gaps(boxes: DataFrame) -> DataFrame:
    """Gap in degrees between each box and its eastern neighbour in the same band of latitude; negative
    where they overlap. ``boxes`` has one row per tile."""
    east = Window.partitionBy("lat_min").orderBy("lon_min", "tile")
    return (
        boxes.withColumn("next_tile", F.lead("tile").over(east))
        .withColumn("gap", F.lead("lon_min").over(east) - F.col("lon_max"))
        .select("tile", "next_tile", "gap")
    )


def reaches_edges(boxes: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Does each box reach the four edges of a region?"""
    return boxes.select(
        "tile",
        F.lit(west).between(F.col("lon_min"), F.col("lon_max")).alias("covers_west"),
        F.lit(east).between(F.col("lon_min"), F.col("lon_max")).alias("covers_east"),
        F.lit(south).between(F.col("lat_min"), F.col("lat_max")).alias("covers_south"),
        F.lit(north).between(F.col("lat_min"), F.col("lat_max")).alias("covers_north"),
    )
