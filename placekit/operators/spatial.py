"""Spatial joins as equi-joins on grid cells with an exact test after.

The side that is looked for is kept once in its cell; the side that looks is repeated over the cells
that its radius can reach, which the radius bounds. So no pairs but those of near cells are made.
"""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekit.functions import geo


def radius_join(left: DataFrame, right: DataFrame, radius: Column, cell: float = 0.01, legacy_window: bool = False, on: tuple[str, str] | None = None) -> DataFrame:
    """Pairs within ``radius`` (a column of left) metres, with ``dist``.

    left has lat, lng; right has r_lat, r_lng. ``legacy_window`` reaches as many cells east and west
    as north and south, which misses pairs away from the equator. ``on``: a column of each side that has to be equal, as part of the key.
    Neither side is broadcast: the size of a file says little about that of its rows in memory.
    """
    up = F.ceil(radius / F.lit(geo.FLAT * cell)).cast("int")
    side = up if legacy_window else F.ceil(radius / (F.cos(F.radians(F.abs("lat") + radius / geo.FLAT)) * geo.FLAT * cell)).cast("int")
    near = left.withColumn("__r", radius).withColumn("__i", F.explode(F.sequence(geo.cell(F.col("lat"), cell).cast("int") - up, geo.cell(F.col("lat"), cell).cast("int") + up)))
    near = near.withColumn("__j", F.explode(F.sequence(geo.cell(F.col("lng"), cell).cast("int") - side, geo.cell(F.col("lng"), cell).cast("int") + side)))
    there = right.withColumn("__ri", geo.cell(F.col("r_lat"), cell).cast("int")).withColumn("__rj", geo.cell(F.col("r_lng"), cell).cast("int"))
    met = (F.col("__i") == F.col("__ri")) & (F.col("__j") == F.col("__rj"))
    out = near.join(there.hint("merge"), met & (F.col(on[0]) == F.col(on[1])) if on else met)
    out = out.withColumn("dist", geo.dist_first(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng")))
    return out.where(F.col("dist") <= F.col("__r")).drop("__i", "__j", "__ri", "__rj", "__r")


def nearest(pairs: DataFrame, key: str, value: list[str], by: list) -> DataFrame:
    """For each key the row least in ``by``; map-side minima, no sort of a group."""
    best = F.min(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(by)], *[F.col(v) for v in value]))
    return pairs.groupBy(key).agg(best.alias("__b")).select(key, *[F.col(f"__b.{v}").alias(v) for v in value])


def at_spots(points: DataFrame, found: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``points`` with what was found for their spot: the columns ``by``, which ``found`` has once each. What many points share is looked for once."""
    there = found.withColumnsRenamed({c: f"__{c}" for c in by})
    met = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in by])
    return points.join(there.hint("merge"), met, how).drop(*[f"__{c}" for c in by])


def box_cover(areas: DataFrame, cell: float) -> DataFrame:
    """``areas`` (x0, y0, x1, y1) once for each cell of its box: ci, cj."""
    i = F.sequence(F.floor(F.col("y0") / F.lit(cell)).cast("int"), F.floor(F.col("y1") / F.lit(cell)).cast("int"))
    j = F.sequence(F.floor(F.col("x0") / F.lit(cell)).cast("int"), F.floor(F.col("x1") / F.lit(cell)).cast("int"))
    return areas.withColumn("ci", F.explode(i)).withColumn("cj", F.explode(j))


def point_in_polygon(points: DataFrame, areas: DataFrame, cell: float = 0.05) -> DataFrame:
    """Points (lat, lng) with the areas (x0, y0, x1, y1, ring) that hold them."""
    p = points.withColumn("pi", geo.cell(F.col("lat"), cell).cast("int")).withColumn("pj", geo.cell(F.col("lng"), cell).cast("int"))
    met = p.join(box_cover(areas, cell), (F.col("pi") == F.col("ci")) & (F.col("pj") == F.col("cj")))
    boxed = met.where(F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    return boxed.where(geo.inside(F.col("ring"), F.col("lng"), F.col("lat"))).drop("pi", "pj", "ci", "cj")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group, by an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
