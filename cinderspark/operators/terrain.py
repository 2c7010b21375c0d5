"""Elevation cells: mosaic, clip, slope, aspect, statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.functions.grid import cell_centre_lat, cell_centre_lon, within
from cinderspark.operators.skew import lookup
from cinderspark.params import TERRAIN_FEATURES, Box, Grid

# Side of the blocks a raster is cut into.
BLOCK = 256


def mosaic(tiles: DataFrame, value: str = "elevation", order: str = "file_order", nodata: float | None = None) -> DataFrame:
    """One value per cell out of overlapping tiles; the later file wins, cells without data do not count."""
    valid = tiles if nodata is None else tiles.where(F.col(value) != nodata)
    return valid.where(F.col(value).isNotNull()).groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def clip(cells: DataFrame, grid: Grid, box: Box) -> DataFrame:
    """Cells whose centre lies in the box."""
    return cells.where(within(cell_centre_lat(F.col("row"), grid), cell_centre_lon(F.col("col"), grid), box))


def _with_neighbours(cells: DataFrame, value: str, block: int) -> DataFrame:
    """Add the eight neighbours as columns nw, n, ne, w, e, sw, s, se (NULL where there is none).

    The raster is cut into blocks that also hold copies of the cells just around them. Both sorts, along
    rows and along columns, then run inside a block: one shuffle, and no task holds more than a block.
    """
    def blocks_of(axis: str) -> Column:
        own = F.floor(F.col(axis) / F.lit(block)).cast("int")
        beside = F.when(F.col(axis) % block == 0, own - 1).when(F.col(axis) % block == block - 1, own + 1)
        return F.array_compact(F.array(own, beside))

    copies = (
        cells.select("row", "col", F.col(value).alias("z"))
        .withColumn("_br", F.explode(blocks_of("row")))
        .withColumn("_bc", F.explode(blocks_of("col")))
        .repartition("_br", "_bc")
    )
    along_row = Window.partitionBy("_br", "_bc", "row").orderBy("col")
    along_col = Window.partitionBy("_br", "_bc", "col").orderBy("row")

    def beside(name: str, shift: int, axis: str, window) -> Column:
        return F.when(F.lag(axis, -shift).over(window) == F.col(axis) + shift, F.lag(name, -shift).over(window))

    rows = copies.withColumns({"w": beside("z", -1, "col", along_row), "e": beside("z", 1, "col", along_row)})
    full = rows.withColumns(
        {
            "nw": beside("w", -1, "row", along_col),
            "n": beside("z", -1, "row", along_col),
            "ne": beside("e", -1, "row", along_col),
            "sw": beside("w", 1, "row", along_col),
            "s": beside("z", 1, "row", along_col),
            "se": beside("e", 1, "row", along_col),
        }
    )
    own_block = (F.col("_br") == F.floor(F.col("row") / F.lit(block))) & (F.col("_bc") == F.floor(F.col("col") / F.lit(block)))
    return full.where(own_block).drop("_br", "_bc")


def _gradient() -> tuple[Column, Column]:
    """Horn's west-east and north-south differences, times 8 cell sizes; NULL at borders and gaps."""
    c = F.col
    across = (c("ne") + c("e") * 2 + c("se")) - (c("nw") + c("w") * 2 + c("sw"))
    along = (c("sw") + c("s") * 2 + c("se")) - (c("nw") + c("n") * 2 + c("ne"))
    return across, along


def slope_aspect(
    cells: DataFrame, value: str = "elevation", xres: float = 1.0, yres: float = 1.0, xscale: float = 1.0, yscale: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """(row, col, elevation, slope, aspect): slope in degrees; aspect clockwise from north, NULL where flat.

    ``xscale``/``yscale`` are vertical units per horizontal unit, ``xres``/``yres`` the cell sizes.
    """
    near = _with_neighbours(cells, value, block)
    across, along = _gradient()
    dx, dy = across / F.lit(8.0 * xres * xscale), along / F.lit(8.0 * yres * yscale)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    turn = F.degrees(F.atan2(along, -across))
    compass = F.when(turn > 90, F.lit(450.0) - turn).otherwise(F.lit(90.0) - turn)
    known = across.isNotNull() & along.isNotNull() & F.col("z").isNotNull()
    steep = (across != 0) | (along != 0)
    wrapped = F.when(compass == 360, 0.0).otherwise(compass)
    return near.select(
        "row", "col", F.col("z").alias(value), F.when(known, slope).alias("slope"), F.when(known & steep, wrapped).alias("aspect")
    )


def sample_terrain(points: DataFrame, terrain: DataFrame, row: str = "terrain_row", col: str = "terrain_col") -> DataFrame:
    """Elevation, slope and aspect of each point's cell; NULL out of the grid."""
    addressed = terrain.select(F.col("row").alias(row), F.col("col").alias(col), *TERRAIN_FEATURES)
    return lookup(points, addressed, [row, col])


def raster_statistics(terrain: DataFrame, names: list[str] = TERRAIN_FEATURES) -> DataFrame:
    """One row per raster: min, max, mean, population standard deviation and count of valid cells."""
    long = terrain.select(*names).unpivot([], names, "product", "value")
    return long.groupBy("product").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("n_valid"),
    )
