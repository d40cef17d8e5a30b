"""Areas of several layers: priority dedupe, relocation of points, rings into parts, paths at equal steps."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.functions import geo
from placekit.operators.components import materialize
from placekit.operators.spatial import at_spots, box_cover, radius_join

OVERLAP = 0.55
#: Parts under this share of the largest one join the nearest part.
SLIVER = 0.03
#: Degrees squared to acres at the equator, and how far a name reaches, in metres.
ACRES, REACH = 111320.0**2 / 4046.86, 8000.0


def layer_dedupe(boxes: DataFrame, layers: list[int], cell: float = 0.02) -> DataFrame:
    """Boxes (layer, id, name, x0, y0, x1, y1) with ``reason``: kept, name or overlap.

    Layers in order of priority: a box goes if it meets a kept one of its name in an earlier layer, or
    if such boxes cover OVERLAP of it, where what two of them cover counts twice. One step for each
    layer; a pair is made in every cell they share and counted in the cell of its lower left corner.
    """
    kept, judged = boxes.limit(0), []
    for layer in layers:
        now = boxes.where(F.col("layer") == layer)
        k = box_cover(kept.select(F.col("name").alias("k_name"), *[F.col(c).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")]).withColumnsRenamed({f"k_{c}": c for c in ("x0", "y0", "x1", "y1")}), cell)
        k = k.withColumnsRenamed({c: f"k_{c}" for c in ("x0", "y0", "x1", "y1", "ci", "cj")})
        left, low = F.greatest("x0", "k_x0"), F.greatest("y0", "k_y0")
        wide, high = F.least("x1", "k_x1") - left, F.least("y1", "k_y1") - low
        pairs = box_cover(now, cell).join(k, (F.col("ci") == F.col("k_ci")) & (F.col("cj") == F.col("k_cj")))
        pairs = pairs.where((wide >= 0) & (high >= 0) & (F.floor(low / F.lit(cell)) == F.col("ci")) & (F.floor(left / F.lit(cell)) == F.col("cj")))
        met = pairs.groupBy(F.col("id").alias("m_id")).agg(F.sum(wide * high).alias("covered"), F.max(F.coalesce(F.col("name") == F.col("k_name"), F.lit(False))).alias("named"))
        area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        reason = F.when(area <= 0, "kept").when(F.col("named"), "name").when(F.col("covered") / area >= OVERLAP, "overlap").otherwise("kept")
        step = materialize(now.join(met, F.col("id") == F.col("m_id"), "left").withColumn("reason", reason).drop("m_id", "covered", "named"))
        judged.append(step)
        kept = kept.unionByName(step.where("reason = 'kept'").drop("reason"))
    out = judged[0]
    for more in judged[1:]:
        out = out.unionByName(more)
    return out


def shape_places(places: DataFrame, boxes: DataFrame, cell: float = 0.02) -> DataFrame:
    """(key, lat, lng, name) -> key, moved, lat, lng, acres, for places that a box holds or that share a near box's name.

    A place that no box of its name holds moves into the largest box of its name whose centre is within
    REACH. Its area is that of all boxes of the best layer and its name; of a place without such a box, the least that holds it.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    b = boxes.withColumn("area", area).withColumn("r_lat", (F.col("y0") + F.col("y1")) / 2).withColumn("r_lng", (F.col("x0") + F.col("x1")) / 2).withColumnRenamed("name", "b_name")
    return moved_places(places, b, ["x0", "y0", "x1", "y1"], F.expr("lng > x0 AND lng < x1 AND lat > y0 AND lat < y1"), cell)


def moved_places(places: DataFrame, b: DataFrame, shape: list[str], holds: Column, cell: float) -> DataFrame:
    """``shape_places`` for areas b (layer, id, b_name, area, x0, y0, x1, y1, r_lat, r_lng) of any ``shape`` (its columns), of which ``holds`` is true.

    Spots meet shapes, each once: the least area that holds a spot is one for all places there, and where names matter they are part of the key.
    """
    there, named = ["lat", "lng"], ["lat", "lng", "name"]

    def held(spots: DataFrame, areas: DataFrame, on: Column) -> DataFrame:
        p = spots.withColumn("pi", geo.cell(F.col("lat"), cell).cast("int")).withColumn("pj", geo.cell(F.col("lng"), cell).cast("int"))
        return p.join(box_cover(areas, cell).hint("merge"), (F.col("pi") == F.col("ci")) & (F.col("pj") == F.col("cj")) & on).where(holds)

    names = places.select(*named).distinct()
    least = held(places.select(*there).distinct(), b.groupBy(*shape).agg(F.min("area").alias("area")), F.lit(True)).groupBy(*there).agg(F.min("area").alias("h_area"))
    own = held(names, b.groupBy(*shape, "b_name").agg(F.min("layer").alias("layer")), F.col("b_name") == F.col("name")).groupBy(*named).agg(F.min("layer").alias("o_layer"))
    middles = b.groupBy("r_lat", "r_lng", "b_name").agg(F.min("layer").alias("layer"), F.min(F.struct((-F.col("area")).alias("a"), "id")).alias("largest"))
    near = radius_join(names, middles, F.lit(REACH), cell=0.04, on=("name", "b_name")).where(F.col("dist") < REACH)
    near = near.groupBy(*named).agg(F.min("layer").alias("n_layer"), F.min(F.struct("largest", "r_lat", "r_lng")).alias("t"))
    out = at_spots(at_spots(at_spots(places, least, there, "left"), own, named, "left"), near, named, "left")
    moved = F.col("o_layer").isNull() & F.col("n_layer").isNotNull()
    out = out.where("h_area IS NOT NULL OR n_layer IS NOT NULL").withColumn("moved", moved).withColumn("a_layer", F.coalesce("o_layer", "n_layer"))
    sums = b.groupBy(F.col("layer").alias("s_layer"), F.col("b_name").alias("s_name")).agg(F.sum("area").alias("s_area"))
    out = out.join(sums, (F.col("a_layer") == F.col("s_layer")) & (F.col("name") == F.col("s_name")), "left")
    lat, lng = (F.when(F.col("moved"), F.round(f"t.r_{c}", 5)).otherwise(F.col(c)) for c in ("lat", "lng"))
    acres = F.when(F.col("a_layer").isNotNull(), F.col("s_area")).otherwise(F.col("h_area")) * F.cos(F.radians(lat)) * ACRES
    return out.select("key", "moved", lat.alias("lat"), lng.alias("lng"), acres.alias("acres"))


def ring_parts(boxes: pd.DataFrame) -> np.ndarray:
    """The part, 0 for the largest, of each ring (x0, y0, x1, y1, area).

    Largest rings first: a ring joins the first part whose box holds its own. Parts under SLIVER of the largest
    then join the part whose middle is nearest, and widen its box.
    """
    box, area = boxes[["x0", "y0", "x1", "y1"]].to_numpy(float), boxes["area"].to_numpy(float)
    part, heads = np.zeros(len(box), np.int64), np.zeros(0, np.int64)
    for i in np.argsort(-area, kind="stable"):
        around = np.flatnonzero((box[heads, :2] <= box[i, :2]).all(1) & (box[heads, 2:] >= box[i, 2:]).all(1))
        part[i] = around[0] if len(around) else len(heads)
        heads = heads if len(around) else np.append(heads, i)
    whole = area[heads] >= SLIVER * area[heads[0]]
    number, wide = np.cumsum(whole) - 1, box[heads[whole]].copy()
    for s in np.flatnonzero(~whole):
        gap = (wide[:, :2] + wide[:, 2:] - box[heads[s], :2] - box[heads[s], 2:]) / 2
        number[s] = best = int((gap**2).sum(1).argmin())
        wide[best] = [*np.minimum(wide[best, :2], box[heads[s], :2]), *np.maximum(wide[best, 2:], box[heads[s], 2:])]
    return number[part]


def resample(xy: np.ndarray, step: float = 0.5, least: int = 6) -> np.ndarray:
    """Points along a path: from the last point made, straight towards each vertex, one at every ``step`` of the way summed up.

    What is left of the way to a vertex is carried to the next, whose way starts again at the last point made.
    Paths of under ``least`` points give none.
    """
    out, carry = [xy[:1]], 0.0
    for to in xy[1:]:
        last = out[-1][-1]
        far = float(np.hypot(*(to - last)))
        n = int((carry + far) // step)
        if n:
            out.append(last + np.outer((step * np.arange(1, n + 1) - carry) / far, to - last))
        carry += far - n * step
    made = np.concatenate(out)
    return made if len(made) >= least else made[:0]


def by_group(df: DataFrame, group: str, schema: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``f`` over each path or place, which is one sequence by its nature."""
    return df.groupBy(group).applyInPandas(f, schema)
