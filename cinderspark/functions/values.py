"""Rules that turn raw cell values into measurements."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale factors and the plausible temperature range (K).
TEMPERATURE_SCALE = 0.02
TEMPERATURE_RANGE = (200.0, 350.0)
REFLECTANCE_SCALE = 10000.0

# Bands and their file codes.
BAND_CODES = {"red": "B01", "nir": "B02", "blue": "B03", "swir1": "B06", "swir2": "B07"}
MIN_BANDS = 4


def rain_mm(raw: Column, nodata: float | None = None) -> Column:
    """Every kind of missing rain is a dry day."""
    value = raw if nodata is None else F.when(raw != F.lit(nodata), raw)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def temperature_k(raw: Column) -> Column:
    kelvin = raw * F.lit(TEMPERATURE_SCALE)
    return F.when(kelvin.between(*TEMPERATURE_RANGE), kelvin)


def reflectance(raw: Column, nodata: float | None = None) -> Column:
    value = raw / F.lit(REFLECTANCE_SCALE)
    return value if nodata is None else F.when(raw != F.lit(nodata), value)


def terrain_value(raw: Column, nodata: float | None = None) -> Column:
    return raw if nodata is None else F.when(raw != F.lit(nodata), raw)


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def _evi_parts(red: Column, nir: Column, blue: Column) -> tuple[Column, Column]:
    return F.lit(2.5) * (nir - red), nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0)


def vegetation_indices(red: Column, nir: Column, blue: Column, swir1: Column, mode: str = "strict") -> dict[str, Column]:
    """NDVI, EVI and NDWI from scaled reflectances.

    ``strict`` needs inputs that are present and a denominator that is not zero. ``positive`` needs
    inputs above zero and does not guard the EVI denominator.
    """
    if mode == "positive":
        red, nir, blue, swir1 = (F.when(band > 0, band) for band in (red, nir, blue, swir1))
    elif mode != "strict":
        raise ValueError(f"unknown mode: {mode}")
    top, bottom = _evi_parts(red, nir, blue)
    return {
        "ndvi": _ratio(nir - red, nir + red),
        "evi": _ratio(top, bottom),
        "ndwi": _ratio(nir - swir1, nir + swir1),
    }
