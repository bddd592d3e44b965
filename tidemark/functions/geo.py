"""Geographic functions as Columns: haversine, units, the interleaved 52-bit score and the geohash string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
LAT_LIMIT = 85.05112878
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * EARTH_M * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def to_unit(metres: Column, unit: str) -> Column:
    """A distance in a unit, to 4 decimals."""
    return F.round(metres / UNITS[unit], 4)


def _spread(x: Column) -> Column:
    """Puts 26 bits on the even positions."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _cell(x: Column, lo: float, hi: float, bits: int) -> Column:
    return F.floor((x - lo) / (hi - lo) * float(1 << bits)).cast("bigint")


def score(lon: Column, lat: Column) -> Column:
    """26 + 26 interleaved bits; latitude on the even positions."""
    return _spread(_cell(lat, -LAT_LIMIT, LAT_LIMIT, 26)).bitwiseOR(F.shiftleft(_spread(_cell(lon, -180.0, 180.0, 26)), 1))


def cell_centre(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The point that a stored score decodes to."""
    half = lambda x, lo, hi: (_cell(x, lo, hi, 26) + 0.5) / float(1 << 26) * (hi - lo) + lo
    return half(lon, -180.0, 180.0), half(lat, -LAT_LIMIT, LAT_LIMIT)


def geohash(lon: Column, lat: Column) -> Column:
    """The standard 11-character geohash (latitudes -90 to 90) of a point, the last character 0."""
    bits = _spread(_cell(lat, -90.0, 90.0, 26)).bitwiseOR(F.shiftleft(_spread(_cell(lon, -180.0, 180.0, 26)), 1))
    chars = [F.substring(F.lit(BASE32), F.shiftright(bits, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10)]
    return F.concat(*chars, F.lit("0"))
