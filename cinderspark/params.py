"""Parameters and fixed values shared by the operators."""

from dataclasses import dataclass, field

# Feature names, in matrix order.
RAIN_FEATURES = ["prec_min", "prec_median", "prec_mean", "prec_max", "prec_sum"]
TEMPERATURE_FEATURES = ["lst_min", "lst_median", "lst_mean", "lst_max"]
NDVI_FEATURES = ["ndvi_min", "ndvi_median", "ndvi_mean", "ndvi_max"]
EVI_FEATURES = ["evi_min", "evi_median", "evi_mean", "evi_max"]
NDWI_FEATURES = ["ndwi_min", "ndwi_median", "ndwi_mean", "ndwi_max"]
TERRAIN_FEATURES = ["elevation", "slope", "aspect"]
FEATURES = (
    RAIN_FEATURES
    + TEMPERATURE_FEATURES
    + NDVI_FEATURES
    + EVI_FEATURES
    + NDWI_FEATURES
    + TERRAIN_FEATURES
)

# Columns of a matrix that are never features.
NOT_FEATURES = ["lat", "lon", "date", "target", "is_fire", "dtw_start", "dtw_end"]

# The nine features scored when no saved selection exists.
DEFAULT_SELECTION = [
    "ndvi_max",
    "prec_mean",
    "prec_max",
    "prec_sum",
    "elevation",
    "ndvi_median",
    "evi_max",
    "ndvi_mean",
    "evi_median",
]


@dataclass(frozen=True)
class Box:
    """A lon/lat box; both edges belong to it."""

    south: float
    north: float
    west: float
    east: float


# Default study region, and the region of the sample configuration.
REGION = Box(south=28.7, north=31.5, west=77.5, east=81.0)
CONFIGURED_REGION = Box(south=28.709556, north=31.459016, west=77.575402, east=81.044789)


@dataclass(frozen=True)
class Lookback:
    """Look-back window: daily and cumulative rain thresholds (mm) and the longest walk (days)."""

    daily_min: float = 10.0
    cum_min: float = 30.0
    max_days: int = 90
    fallback_days: int = 30


@dataclass(frozen=True)
class Grid:
    """North-up affine grid: (x0, y0) is the north-west corner, cells are dx by dy degrees."""

    x0: float
    y0: float
    dx: float
    dy: float
    nrows: int
    ncols: int


@dataclass(frozen=True)
class Negatives:
    """Rules for no-fire points."""

    ratio: float = 1.0
    tries_per_point: int = 10
    min_km: float = 5.0
    max_rain_mm: float = 10.0
    box: Box = field(default=REGION)
