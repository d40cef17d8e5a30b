"""Distances, cells, tiles and polygons as column expressions. Degrees in, metres out."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of a degree and of the Earth's radius in the formulas that operators name.
FLAT, DEGREE, MERIDIAN, EARTH_KM, ACRE = 111000.0, 111320.0, 110574.0, 6371.0, 4047.0


def _flat(lat1, lng1, lat2, lng2, ky: float, kx: float, at: Column) -> Column:
    dy, dx = (lat2 - lat1) * ky, (lng2 - lng1) * kx * F.cos(F.radians(at))
    return F.sqrt(dy * dy + dx * dx)


def dist_first(lat1, lng1, lat2, lng2) -> Column:
    """Flat distance at the first point's latitude."""
    return _flat(lat1, lng1, lat2, lng2, FLAT, FLAT, lat1)


def dist_mean(lat1, lng1, lat2, lng2) -> Column:
    """Flat distance at the mean latitude."""
    return _flat(lat1, lng1, lat2, lng2, DEGREE, DEGREE, (lat1 + lat2) / 2)


def dist_ellipse(lat1, lng1, lat2, lng2) -> Column:
    return _flat(lat1, lng1, lat2, lng2, MERIDIAN, DEGREE, lat1)


def _arc_km(dy: Column, dx: Column, lat1: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(dy) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(dx) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    return _arc_km(lat2 - lat1, lng2 - lng1, lat1, lat2)


def box_km(a: Column, b: Column) -> tuple[Column, Column]:
    """Bounds of ``haversine_km`` between any points of two boxes (structs of y0, y1, x0, x1), which lie less than half a turn apart."""
    gap = [F.greatest(b[f"{c}0"] - a[f"{c}1"], a[f"{c}0"] - b[f"{c}1"], F.lit(0.0)) for c in "yx"]
    span = [F.greatest(a[f"{c}1"] - b[f"{c}0"], b[f"{c}1"] - a[f"{c}0"]) for c in "yx"]
    # a degree of longitude is least at the latitude farthest from the equator
    most = [F.greatest(F.abs(x["y0"]), F.abs(x["y1"])) for x in (a, b)]
    least = [F.greatest(x["y0"], -x["y1"], F.lit(0.0)) for x in (a, b)]
    return _arc_km(*gap, *most), _arc_km(*span, *least)


def radius_m(acres: Column) -> Column:
    """Radius of a disc of that area, from 90 to 2200 m; 120 m if unknown."""
    return F.when(F.coalesce(acres, F.lit(0)) <= 0, 120.0).otherwise(F.least(F.lit(2200.0), F.greatest(F.lit(90.0), F.sqrt(acres * ACRE / math.pi))))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def tile_x(lng: Column, z: Column) -> Column:
    return (lng + 180.0) / 360.0 * F.pow(F.lit(2.0), z)


def tile_y(lat: Column, z: Column) -> Column:
    r = F.radians(F.least(F.lit(85.0511287798066), F.greatest(F.lit(-85.0511287798066), lat)))
    return (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), z)


def shoelace(ring: Column) -> Column:
    """Signed area of a closed ring of struct<x, y> in its own units."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + (F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"])) / 2


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    n = F.size(ring)

    def crossing(odd, i):
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        # the division is reached for edges only that the point's latitude meets
        meets = (a["y"] > y) != (b["y"] > y)
        return odd != (meets & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]))

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(False), crossing)
