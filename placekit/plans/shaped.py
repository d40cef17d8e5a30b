"""Areas that are no boxes: layers, places, clips, holes, simpler rings, tiles, and shapes drawn in turn."""

import math

import pandas as pd
from pyspark.sql import functions as F

from placekit.functions import geo, names
from placekit.operators import polygons, tiles
from placekit.operators.components import connected_components, materialize
from placekit.operators.spatial import box_cover, radius_join
from placekit.plans.adapter import prelude, view
from placekit.plans.joins import _other
from placekit.plans.registry import SQL, query
from placekit.plans.values import judged

#: Corners of a star, in and out.
CORNERS = 10


def stars(spark, sf):
    """An area in and out around each supplier: layer, id, name, rings."""
    r = view(spark, sf, "R")
    size = F.lit(0.01) + F.lit(0.01) * (F.col("key") % 4)
    flat = []
    for k in [*range(CORNERS), 0]:
        turn, far = 2 * math.pi * k / CORNERS, 1.0 if k % 2 else 0.5
        flat += [F.col("lng") + size * (far * math.cos(turn)), F.col("lat") + size * (far * math.sin(turn))]
    return r.select((F.col("key") % 7).cast("int").alias("layer"), F.col("key").alias("id"), F.lower("name").alias("name"), F.array(F.array(*flat)).alias("rings"))


@query("concave_layers")
def concave_layers(spark, sf):
    """Stars of seven layers, each kept unless an earlier layer covers or names it."""
    return polygons.dedupe_layers(stars(spark, sf), list(range(7))).select("layer", "id", "reason")


@query("concave_places")
def concave_places(spark, sf):
    """Places moved into stars of their names, with the acres of these."""
    p = view(spark, sf, "P").select("key", "lat", "lng", F.lower("name").alias("name"))
    out = polygons.shape_places(p, stars(spark, sf))
    return out.select("key", "moved", F.floor(F.col("lat") * 1000 + 0.25).alias("lat_e3"), F.floor(F.col("acres") + 0.5).alias("acres"))


@query("concave_clips")
def concave_clips(spark, sf):
    """Share of each star that a region holds, in millionths; those outside are left out."""
    box = [F.lit(v) for v in (-73.42, 41.05, -73.08, 41.4)]
    s = polygons.corners(stars(spark, sf)).where("x1 > -73.42 AND x0 < -73.08 AND y1 > 41.05 AND y0 < 41.4")
    s = s.withColumn("cut", polygons.clipped("rings", *box))
    share = polygons.area_of("cut") / polygons.area_of("rings")
    return s.where(F.size("cut") > 0).select("id", F.floor(share * 1e6 + 0.5).alias("kept_ppm"))


@query("tile_stage")
def tile_stage(spark, sf):
    """Tiles of the stars at two zooms: number, size on record and a digest of what they hold."""
    layer = F.element_at(F.array(*[F.lit(n) for n in tiles.LAYER_ZOOMS]), F.col("layer") + 1)
    features = stars(spark, sf).select("id", layer.alias("layer"), F.lit(tiles.AREAS).alias("kind"), "rings", F.create_map(F.lit("name"), "name").alias("props"))
    return tiles.stage(features, [9, 12]).select("z", "x", "y", "tile_id", F.sha2("data", 256).alias("sha256"))


@query("towns_with_holes", prelude("P", "M") + " SELECT p.key, m.id AS town FROM P p JOIN M m ON p.lng > m.x0 AND p.lng <= m.x1 AND p.lat > m.y0 AND p.lat <= m.y1 AND NOT (p.lng > m.x0 + 0.03 AND p.lng <= m.x0 + 0.06 AND p.lat > m.y0 + 0.03 AND p.lat <= m.y0 + 0.06)")
def towns_with_holes(spark, sf):
    """Places by the town that holds them, where towns have holes: inside an odd number of rings."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = lambda a, b, c, d: F.array(a, b, c, b, c, d, a, d, a, b)
    m = view(spark, sf, "M").withColumn("rings", F.array(ring(x0, y0, x1, y1), ring(x0 + 0.03, y0 + 0.03, x0 + 0.06, y0 + 0.06)))
    p = view(spark, sf, "P").select("key", "lat", "lng", geo.cell(F.col("lat"), 0.05).cast("int").alias("pi"), geo.cell(F.col("lng"), 0.05).cast("int").alias("pj"))
    met = p.join(box_cover(m, 0.05), (F.col("pi") == F.col("ci")) & (F.col("pj") == F.col("cj"))).where("lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
    return met.where(polygons.holds(F.col("rings"), F.col("lng"), F.col("lat"))).select("key", F.col("id").alias("town"))


@query("simpler_rings", prelude("M") + " SELECT id, CAST(5 AS BIGINT) AS corners, CAST(9 AS BIGINT) AS before FROM M")
def simpler_rings(spark, sf):
    """Rings with a point in the middle of each side, which a straight side doesn't need."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    m = view(spark, sf, "M").withColumn("rings", F.array(F.array(x0, y0, mx, y0, x1, y0, x1, my, x1, y1, mx, y1, x0, y1, x0, my, x0, y0)))
    made = polygons.simpler("rings", F.lit(tiles.tolerance(12)))
    return m.select("id", F.floor(F.size(F.get(made, F.lit(0))) / 2).alias("corners"), F.floor(F.size(F.get("rings", F.lit(0))) / 2).alias("before"))


@query("trail_access", "WITH J AS (SELECT * FROM (" + SQL["trail_cell_semi"] + ") WHERE has_trail), " + prelude("P").removeprefix("WITH ") + ", Q AS (SELECT P.* REPLACE (P.trails OR J.key IS NOT NULL AS trails) FROM P LEFT JOIN J ON P.key = J.key), B AS (SELECT key, trails, CASE WHEN private THEN 'closed' WHEN official = 'Closed' THEN 'closed' WHEN official = 'Open' THEN 'open' WHEN official = 'Restricted' THEN 'permission' WHEN type IN ('state', 'national', 'town') THEN 'open' ELSE 'permission' END AS first, trails OR parking OR sports OR playground OR beach OR pool AS visit, reachable, official FROM Q) SELECT key, trails, CASE WHEN NOT visit AND NOT reachable AND first <> 'closed' AND official IS NULL THEN 'unknown' ELSE first END AS access FROM B")
def trail_access(spark, sf):
    """Access of every place once the trails near it count."""
    from placekit.functions import verdicts
    from placekit.plans.joins import trail_cell_semi

    near = trail_cell_semi(spark, sf).where("has_trail").select(F.col("key").alias("t_key"))
    p = view(spark, sf, "P").join(near, F.col("key") == F.col("t_key"), "left").withColumn("trails", F.col("trails") | F.col("t_key").isNotNull())
    return p.select("key", "trails", verdicts.access().alias("access"))


NAME_M, LEAST_M, MOST_M = 1600.0, 90.0, 400.0


@query("shapes_in_turn")
def shapes_in_turn(spark, sf):
    """Shapes added one after the other: one is left out if something drawn before it - from the start, or added - has its name near by or
    lies almost on top of it. What can be in one's way is near it, so the fold runs for each component of near pairs."""
    c = view(spark, sf, "C").select("key", "lat", "lng", "rad", names.norm(F.col("name")).alias("nm"))
    tol = F.least(F.lit(MOST_M), F.greatest(F.lit(LEAST_M), F.col("rad") * 0.28))
    in_way = lambda near: near.where(((F.col("nm") != "") & (F.col("r_nm") == F.col("nm")) & (F.col("dist") < NAME_M)) | (F.col("dist") < tol))
    drawn = _other(spark, sf, "R", "name").withColumn("r_nm", names.norm(F.col("r_name")))
    blocked = in_way(radius_join(c, drawn, F.lit(NAME_M), cell=0.02)).select(F.col("key").alias("b_key")).distinct()
    free = materialize(c.join(blocked, F.col("key") == F.col("b_key"), "left_anti"))
    earlier = in_way(radius_join(free, free.select(F.col("key").alias("r_key"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("nm").alias("r_nm")), F.lit(NAME_M), cell=0.02).where("r_key < key"))
    pairs = materialize(earlier.select("key", "r_key").distinct())
    labels = materialize(connected_components(pairs.select(F.col("key").alias("a"), F.col("r_key").alias("b"))))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": _in_turn(pdf)}, dtype="int64")

    alone = free.join(labels, F.col("key") == F.col("node"), "left_anti").select("key")
    folded = pairs.join(labels, F.col("key") == F.col("node")).groupBy("label").applyInPandas(fold, "key long")
    return alone.unionByName(folded)


def _in_turn(pairs: pd.DataFrame) -> list[int]:
    """Keys that are added, in order, where each has the earlier keys (r_key) that would be in its way."""
    ways = {k: set(g) for k, g in pairs.groupby("key")["r_key"]}
    added: set = set()
    for key in sorted({*ways, *pairs["r_key"]}):
        if not added & ways.get(key, set()):
            added.add(key)
    return sorted(int(k) for k in added)
