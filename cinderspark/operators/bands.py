"""Reflectance bands per cell and day, and the indices made of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.functions.values import BAND_CODES, MIN_BANDS, REFLECTANCE_SCALE, vegetation_indices

BANDS = list(BAND_CODES)


def assemble(
    cells: DataFrame, key: list[str], day: str, band: str = "band", raw: str = "raw", nodata: float | None = None
) -> DataFrame:
    """One row per key and day with a raw column (double) per band; a day needs at least four bands present.

    A band whose value is ``nodata`` is present, but NULL.
    """
    known = cells.where(F.col(band).isin(BANDS))
    value = F.col(raw) if nodata is None else F.when(F.col(raw) != nodata, F.col(raw))
    columns = [F.max(F.when(F.col(band) == name, value)).cast("double").alias(name) for name in BANDS]
    return (
        known.groupBy(*key, day)
        .agg(*columns, F.count(F.lit(1)).alias("_present"))
        .where(F.col("_present") >= MIN_BANDS)
        .drop("_present")
    )


def indices_per_day(wide: DataFrame, mode: str = "strict", keep_bands: bool = False) -> DataFrame:
    """NDVI, EVI, NDWI of each row of raw bands."""
    scaled = {b: F.col(b) / F.lit(REFLECTANCE_SCALE) for b in BANDS}
    made = vegetation_indices(scaled["red"], scaled["nir"], scaled["blue"], scaled["swir1"], mode)
    out = wide.select("*", *[c.alias(n) for n, c in made.items()])
    return out if keep_bands else out.drop(*BANDS)
