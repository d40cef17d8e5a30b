"""Areas of any shape: layers that cover one another, places and the areas that hold them.

An area has ``rings``: arrays x0, y0, x1, y1, ... of its rings, of which a point has to be inside an odd number. Boxes and cells
find the pairs, as for plain boxes; the shapes themselves are compared by Arrow batches of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from placekit.functions import shapes
from placekit.operators.components import materialize
from placekit.operators.layers import ACRES, OVERLAP, moved_places  # noqa: F401  ACRES is read from here too
from placekit.operators.spatial import box_cover

RINGS = "array<array<double>>"


def _rings(r) -> list[np.ndarray]:
    return [np.asarray(x, float).reshape(-1, 2) for x in r]


@F.pandas_udf(DoubleType())
def common_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shapes.common_area(_rings(x), _rings(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def area_of(a: pd.Series) -> pd.Series:
    return pd.Series([shapes.area(_rings(x)) for x in a], dtype="float64")


@F.pandas_udf(BooleanType())
def touches(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shapes.touch(_rings(x), _rings(y)) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def simpler(a: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([[shapes.simplify(r, t, 4).reshape(-1).tolist() for r in _rings(x)] for x, t in zip(a, tolerance, strict=True)])


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def clipped(a: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    made = ([shapes.clip_ring(r, box) for r in _rings(x)] for x, *box in zip(a, x0, y0, x1, y1, strict=True))
    return pd.Series([[r.reshape(-1).tolist() for r in rings if len(r) > 2] for rings in made])


def corners(areas: DataFrame) -> DataFrame:
    """``areas`` with the box of their rings: x0, y0, x1, y1."""
    every = F.flatten("rings")
    xs, ys = F.filter(every, lambda _, i: i % 2 == 0), F.filter(every, lambda _, i: i % 2 == 1)
    return areas.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def holds(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings, without Python."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring) / 2

        def step(k: Column) -> Column:
            a, b = 2 * k, F.when(k + 1 < n, 2 * k + 2).otherwise(F.lit(0))
            ax, ay, bx, by = (F.element_at(ring, (i + 1).cast("int")) for i in (a, a + 1, b, b + 1))
            return ((ay > y) != (by > y)) & (x < ax + (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) * (bx - ax))

        return F.size(F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), step))

    return F.aggregate(rings, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1


def dedupe_layers(areas: DataFrame, layers: list[str], cell: float = 0.02) -> DataFrame:
    """Areas (layer, id, name, rings) with ``reason``: kept, name or overlap.

    Layers in order of priority: an area goes if it touches a kept one of its name in an earlier layer, or if such areas
    cover OVERLAP of it, where what two of them cover counts twice. An area without extent stays and covers nothing. A pair is looked at once, in
    the cell of the lower left corner of what their boxes share. What goes by its name is settled first, among areas of that name alone; shared areas are for the rest.
    """
    boxed = materialize(corners(areas).withColumn("area", area_of("rings")))
    kept, judged = boxed.limit(0), []
    for layer in layers:
        now = boxed.where(F.col("layer") == layer)
        k = box_cover(kept.where("area > 0"), cell).select(*[F.col(c).alias(f"k_{c}") for c in ("name", "rings", "x0", "y0", "x1", "y1", "ci", "cj")])
        left, low = F.greatest("x0", "k_x0"), F.greatest("y0", "k_y0")
        meet = (left <= F.least("x1", "k_x1")) & (low <= F.least("y1", "k_y1"))

        def pairs(of: DataFrame, on: Column) -> DataFrame:
            both = box_cover(of.where("area > 0"), cell).join(k.hint("merge"), (F.col("ci") == F.col("k_ci")) & (F.col("cj") == F.col("k_cj")) & on)
            return both.where(meet & (F.floor(low / F.lit(cell)) == F.col("ci")) & (F.floor(left / F.lit(cell)) == F.col("cj")))

        same = pairs(now.where("name <> ''"), F.col("name") == F.col("k_name")).where(touches("rings", "k_rings"))
        named = materialize(same.select(F.col("id").alias("n_id")).distinct())
        rest = now.join(named, F.col("id") == F.col("n_id"), "left_anti")
        met = pairs(rest, F.lit(True)).withColumn("shared", common_area("rings", "k_rings")).groupBy(F.col("id").alias("m_id")).agg(F.sum("shared").alias("covered"))
        reason = F.when(F.col("n_id").isNotNull(), "name").when(F.col("covered") / F.col("area") >= OVERLAP, "overlap").otherwise("kept")
        step = now.join(named, F.col("id") == F.col("n_id"), "left").join(met, F.col("id") == F.col("m_id"), "left")
        step = materialize(step.withColumn("reason", reason).drop("n_id", "m_id", "covered"))
        judged.append(step)
        kept = kept.unionByName(step.where("reason = 'kept'").drop("reason"))
    out = judged[0]
    for more in judged[1:]:
        out = out.unionByName(more)
    return out.select("layer", "id", "name", "area", "reason")


def shape_places(places: DataFrame, areas: DataFrame, cell: float = 0.02) -> DataFrame:
    """(key, lat, lng, name) -> key, moved, lat, lng, acres, for places that an area holds or that share a near area's name.

    areas: layer (a number, the best least), id, name, rings. A place that no area of its name holds moves into the largest area of its name whose middle is
    within REACH. Its acres are those of all areas of the best layer and its name; of a place without such an area, those of
    the least area that holds it.
    """
    b = materialize(corners(areas).withColumn("area", area_of("rings"))).withColumnRenamed("name", "b_name")
    b = b.withColumn("r_lat", (F.col("y0") + F.col("y1")) / 2).withColumn("r_lng", (F.col("x0") + F.col("x1")) / 2)
    inside = F.expr("lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1") & holds(F.col("rings"), F.col("lng"), F.col("lat"))
    return moved_places(places, b, ["rings", "x0", "y0", "x1", "y1"], inside, cell)
