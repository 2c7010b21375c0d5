"""Grid and tile arithmetic as Column expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.params import Box, Grid

# Sphere radius of the sinusoidal projection (m), side of one 10-degree tile (m),
# western and northern edge of the tile grid (m).
SPHERE_RADIUS = 6371007.181
TILE_SIDE = 1111950.5197
GRID_WEST = -20015109.354
GRID_NORTH = 10007554.677

# Kilometres per degree in the planar distance.
KM_PER_DEGREE = 111.0

# lon/lat boxes of the tiles of the study region, in lookup order.
TILE_BOXES = [
    ("h24v05", 69.28, 91.38, 30.00, 40.00),
    ("h24v06", 63.85, 80.83, 20.00, 30.00),
    ("h25v06", 74.49, 92.38, 20.00, 30.00),
]


def grid_row(lat: Column, grid: Grid) -> Column:
    return F.floor((F.lit(grid.y0) - lat) / F.lit(grid.dy)).cast("bigint")


def grid_col(lon: Column, grid: Grid) -> Column:
    return F.floor((lon - F.lit(grid.x0)) / F.lit(grid.dx)).cast("bigint")


def in_grid(row: Column, col: Column, grid: Grid) -> Column:
    return (row >= 0) & (row < grid.nrows) & (col >= 0) & (col < grid.ncols)


def cell_centre_lat(row: Column, grid: Grid) -> Column:
    return F.lit(grid.y0) - (row + F.lit(0.5)) * F.lit(grid.dy)


def cell_centre_lon(col: Column, grid: Grid) -> Column:
    return F.lit(grid.x0) + (col + F.lit(0.5)) * F.lit(grid.dx)


def sinusoidal_x(lat: Column, lon: Column) -> Column:
    return F.lit(SPHERE_RADIUS) * F.radians(lon) * F.cos(F.radians(lat))


def sinusoidal_y(lat: Column) -> Column:
    return F.lit(SPHERE_RADIUS) * F.radians(lat)


def inverse_lat(y: Column) -> Column:
    return F.degrees(y / F.lit(SPHERE_RADIUS))


def inverse_lon(x: Column, y: Column) -> Column:
    return F.degrees(x / (F.lit(SPHERE_RADIUS) * F.cos(y / F.lit(SPHERE_RADIUS))))


def tile_name(h: Column, v: Column) -> Column:
    return F.format_string("h%02dv%02d", h, v)


def simple_h(lon: Column) -> Column:
    return ((lon + 180) / 10).cast("bigint")


def simple_v(lat: Column) -> Column:
    return ((F.lit(90) - lat) / 10).cast("bigint")


def simple_tile(lat: Column, lon: Column) -> Column:
    """Tile id on a plain 10-degree grid; off for the sinusoidal projection."""
    return tile_name(simple_h(lon), simple_v(lat))


def exact_h(lat: Column, lon: Column) -> Column:
    return F.floor((sinusoidal_x(lat, lon) - F.lit(GRID_WEST)) / F.lit(TILE_SIDE)).cast("bigint")


def exact_v(lat: Column) -> Column:
    return F.floor((F.lit(GRID_NORTH) - sinusoidal_y(lat)) / F.lit(TILE_SIDE)).cast("bigint")


def exact_tile(lat: Column, lon: Column) -> Column:
    """Tile whose projected bounds hold the point, in closed form."""
    return tile_name(exact_h(lat, lon), exact_v(lat))


def tile_number(tile: Column, axis: str) -> Column:
    return F.regexp_extract(tile, axis + r"(\d{2})", 1).cast("bigint")


def within(lat: Column, lon: Column, box: Box) -> Column:
    return lat.between(box.south, box.north) & lon.between(box.west, box.east)


def strictly_within(lat: Column, lon: Column, box: Box) -> Column:
    return (lat > box.south) & (lat < box.north) & (lon > box.west) & (lon < box.east)


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return F.sqrt(dlat * dlat + dlon * dlon) * F.lit(KM_PER_DEGREE)


def tile_boxes(spark: SparkSession) -> DataFrame:
    """The lookup boxes as a table of three rows, ``ord`` giving the lookup order."""
    rows = [(i, *box) for i, box in enumerate(TILE_BOXES)]
    return spark.createDataFrame(
        rows, "ord int, tile string, lon_min double, lon_max double, lat_min double, lat_max double"
    )


def neighbour_tiles(df: DataFrame, lat: str, lon: str, size: int = 3) -> DataFrame:
    """One row per neighbour tile in a size-by-size block; ``ord`` counts h first, then v."""
    half = size // 2
    steps = F.sequence(F.lit(-half), F.lit(half))
    blocks = (
        df.withColumn("dh", F.explode(steps))
        .withColumn("dv", F.explode(steps))
        .withColumn("h", simple_h(F.col(lon)) + F.col("dh"))
        .withColumn("v", simple_v(F.col(lat)) + F.col("dv"))
    )
    return (
        blocks.where(F.col("h").between(0, 35) & F.col("v").between(0, 17))
        .withColumn("ord", (F.col("dh") + half) * size + F.col("dv") + half)
        .withColumn("tile", tile_name(F.col("h"), F.col("v")))
        .drop("dh", "dv", "h", "v")
    )


def matching_boxes(lat: Column, lon: Column) -> Column:
    """Array of tile ids, in lookup order, whose box holds the point; NULL-free, maybe empty."""
    hits = [
        F.when(lon.between(w, e) & lat.between(s, n), F.lit(tile)) for tile, w, e, s, n in TILE_BOXES
    ]
    return F.array_compact(F.array(*hits))


def tile_lonlat_box(tile: Column) -> tuple[Column, Column, Column, Column]:
    """(lon_min, lon_max, lat_min, lat_max) of a plain 10-degree tile."""
    h, v = tile_number(tile, "h"), tile_number(tile, "v")
    return (
        (h * 10 - 180).cast("double"),
        ((h + 1) * 10 - 180).cast("double"),
        (F.lit(90) - (v + 1) * 10).cast("double"),
        (F.lit(90) - v * 10).cast("double"),
    )


def tile_projected_bounds(tile: Column) -> tuple[Column, Column, Column, Column]:
    """(x_min, x_max, y_min, y_max) of a sinusoidal tile in metres."""
    h, v = tile_number(tile, "h"), tile_number(tile, "v")
    x_min = F.lit(GRID_WEST) + h * F.lit(TILE_SIDE)
    y_max = F.lit(GRID_NORTH) - v * F.lit(TILE_SIDE)
    return x_min, x_min + F.lit(TILE_SIDE), y_max - F.lit(TILE_SIDE), y_max


def tile_geographic_bounds(tile: Column) -> tuple[Column, Column, Column, Column]:
    """(lon_min, lon_max, lat_min, lat_max) spanned by the corners of a sinusoidal tile."""
    x_min, x_max, y_min, y_max = tile_projected_bounds(tile)
    lons = [inverse_lon(x, y) for x in (x_min, x_max) for y in (y_min, y_max)]
    return F.least(*lons), F.greatest(*lons), inverse_lat(y_min), inverse_lat(y_max)


def boxes_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Touching counts; boxes are (x_min, x_max, y_min, y_max)."""
    return (a[0] <= b[1]) & (a[1] >= b[0]) & (a[2] <= b[3]) & (a[3] >= b[2])


def tiles_covering(df: DataFrame, south: str, north: str, west: str, east: str, samples: int = 10) -> DataFrame:
    """Plain tiles hit by a samples-by-samples lattice over the box of each row."""
    last = samples - 1
    lattice = F.sequence(F.lit(0), F.lit(last))
    lat = F.col(south) + F.col("i") * (F.col(north) - F.col(south)) / last
    lon = F.col(west) + F.col("j") * (F.col(east) - F.col(west)) / last
    return (
        df.withColumn("i", F.explode(lattice))
        .withColumn("j", F.explode(lattice))
        .withColumn("tile", simple_tile(lat, lon))
        .drop("i", "j")
        .distinct()
    )
