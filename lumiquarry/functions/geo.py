"""M2 to M4: distances on the earth and in degrees. The constants differ by use and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two earth radii, and kilometres to a degree.
EARTH_M, EARTH_KM = 6_371_000.0, 6371.0088
KM_PER_DEG_LAT, KM_PER_DEG_EQUATOR = 111.0, 111.32


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))


def _arc(a: Column) -> Column:
    """asin of the root, the root at most 1; null stays null, which ``least`` would pass over."""
    root = F.sqrt(a)
    return F.asin(F.when(root > 1, 1.0).otherwise(root))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * EARTH_M * _arc(_half_chord(lat1, lon1, lat2, lon2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * EARTH_KM * _arc(_half_chord(lat1, lon1, lat2, lon2))


def km_per_deg_lon(lat: Column) -> Column:
    return KM_PER_DEG_EQUATOR * F.cos(F.radians(lat))


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance with the degree of longitude at the mean latitude."""
    return F.sqrt(F.pow((lat1 - lat2) * KM_PER_DEG_LAT, F.lit(2)) + F.pow((lon1 - lon2) * km_per_deg_lon((lat1 + lat2) / 2), F.lit(2)))


def equirect_merge_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The variant of place merging: one degree is as long both ways before the cosine."""
    return F.sqrt(F.pow((lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2)), F.lit(2)) + F.pow(lat1 - lat2, F.lit(2))) * KM_PER_DEG_LAT


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, F.lit(2)) + F.pow(lon1 - lon2, F.lit(2)))


def svg_xy(lat: Column, lon: Column, low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column, *, width: float = 600, height: float = 300, pad: float = 24) -> tuple[Column, Column]:
    """A route point in the picture's plane, north up, one scale both ways."""
    span = F.greatest(high_lat - low_lat, high_lon - low_lon, F.lit(1e-6))
    scale = F.least(F.lit(width - 2 * pad), F.lit(height - 2 * pad)) / span
    return pad + (lon - low_lon) * scale, height - pad - (lat - low_lat) * scale


def svg_points(points: Column) -> Column:
    """The ``points`` text of a line from an array of structs x, y."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.1f,%.1f", p["x"], p["y"])), " ")
