"""Layers of areas, labels and marks by rank, rings and paths."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from placekit.operators import layers
from placekit.operators.spatial import point_in_polygon
from placekit.plans.adapter import prelude, view
from placekit.plans.joins import _IN, towns
from placekit.plans.registry import query

_HALF = "(0.01::DOUBLE + 0.01::DOUBLE * (key % 4))"
_BOX = f"X AS (SELECT key AS id, key % 7 AS layer, lower(name) AS name, lng - {_HALF} AS x0, lat - {_HALF} AS y0, lng + {_HALF} AS x1, lat + {_HALF} AS y1 FROM R)"


def boxes(spark, sf):
    half = F.lit(0.01) + F.lit(0.01) * (F.col("key") % 4)
    corners = {c: F.col(v) + s * half for c, v, s in (("x0", "lng", -1), ("y0", "lat", -1), ("x1", "lng", 1), ("y1", "lat", 1))}
    return view(spark, sf, "R").select(F.col("key").alias("id"), (F.col("key") % 7).alias("layer"), F.lower("name").alias("name"), *[c.alias(n) for n, c in corners.items()])


def _folded() -> str:
    """SQL of the fold: one step for each layer over what the steps before kept."""
    steps = ["J0 AS (SELECT *, 'kept' AS reason FROM X WHERE layer = 0)", "K0 AS (SELECT * FROM X WHERE layer = 0)"]
    shared = "(least(b.x1, k.x1) - greatest(b.x0, k.x0)) * (least(b.y1, k.y1) - greatest(b.y0, k.y0))"
    for n in range(1, 7):
        met = f"SELECT b.id, sum({shared}) AS covered, bool_or(b.name = k.name) AS named FROM X b JOIN K{n - 1} k ON b.x0 <= k.x1 AND k.x0 <= b.x1 AND b.y0 <= k.y1 AND k.y0 <= b.y1 WHERE b.layer = {n} GROUP BY b.id"
        steps.append(f"J{n} AS MATERIALIZED (SELECT X.*, CASE WHEN m.named THEN 'name' WHEN m.covered / ((x1 - x0) * (y1 - y0)) >= {layers.OVERLAP} THEN 'overlap' ELSE 'kept' END AS reason FROM X LEFT JOIN ({met}) m ON X.id = m.id WHERE layer = {n})")
        steps.append(f"K{n} AS MATERIALIZED (SELECT * FROM K{n - 1} UNION ALL SELECT * EXCLUDE (reason) FROM J{n} WHERE reason = 'kept')")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT layer, id, reason FROM J{n}" for n in range(7))


@query("tile_layer_dedupe", prelude("R") + f", {_BOX}, {_folded()}")
def tile_layer_dedupe(spark, sf):
    return layers.layer_dedupe(boxes(spark, sf), list(range(7))).select("layer", "id", "reason")


_NEAR = "111000 * sqrt(power((x.y0 + x.y1) / 2 - p.lat, 2) + power(((x.x0 + x.x1) / 2 - p.lng) * cos(radians(p.lat)), 2)) < 8000"
_SHAPED = (
    "A AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM X), Q AS (SELECT key, lat, lng, lower(name) AS name FROM P), "
    "H AS (SELECT p.key, x.id, x.layer, x.area, x.name = p.name AS own FROM Q p JOIN A x ON p.lng > x.x0 AND p.lng < x.x1 AND p.lat > x.y0 AND p.lat < x.y1), "
    f"N AS (SELECT p.key, x.id, x.layer, x.area, (x.y0 + x.y1) / 2 AS t_lat, (x.x0 + x.x1) / 2 AS t_lng FROM Q p JOIN A x ON p.name = x.name AND {_NEAR}), "
    "HO AS (SELECT key, min(layer) AS layer FROM H WHERE own GROUP BY key), HA AS (SELECT key, min(area) AS area FROM H GROUP BY key), "
    "NL AS (SELECT key, min(layer) AS layer FROM N GROUP BY key), NT AS (SELECT key, t_lat, t_lng FROM N QUALIFY row_number() OVER (PARTITION BY key ORDER BY area DESC, id) = 1), "
    "S AS (SELECT layer, name, sum(area) AS area FROM A GROUP BY 1, 2), "
    "Z AS (SELECT Q.key, HO.key IS NULL AND NL.key IS NOT NULL AS moved, CASE WHEN HO.key IS NULL AND NL.key IS NOT NULL THEN round(t_lat, 5) ELSE lat END AS lat, CASE WHEN coalesce(HO.layer, NL.layer) IS NOT NULL THEN S.area ELSE HA.area END AS area "
    "FROM Q LEFT JOIN HO ON Q.key = HO.key LEFT JOIN NL ON Q.key = NL.key LEFT JOIN NT ON Q.key = NT.key LEFT JOIN HA ON Q.key = HA.key LEFT JOIN S ON S.name = Q.name AND S.layer = coalesce(HO.layer, NL.layer) WHERE HA.key IS NOT NULL OR NL.key IS NOT NULL) "
)


@query("shape_relocate", prelude("P", "R") + f", {_BOX}, {_SHAPED} SELECT key, moved, CAST(floor(lat * 1000 + 0.25) AS BIGINT) AS lat_e3, CAST(floor(area * cos(radians(lat)) * {layers.ACRES}::DOUBLE + 0.5) AS BIGINT) AS acres FROM Z")
def shape_relocate(spark, sf):
    places = view(spark, sf, "P").select("key", "lat", "lng", F.lower("name").alias("name"))
    out = layers.shape_places(places, boxes(spark, sf))
    return out.select("key", "moved", F.floor(F.col("lat") * 1000 + 0.25).alias("lat_e3"), F.floor(F.col("acres") + 0.5).alias("acres"))


# Which labels and which public buildings come first.
LABELS = [("access", 0), ("summit", 1), ("lake|reservoir", 2), ("ridge|falls|gap|cliff", 3)]
PUBLIC = ["library", "townhall", "museum", "community", "post", "worship", "school", "civic"]
_ORDER = "CASE " + " ".join(f"WHEN regexp_matches(cls, '{p}') THEN {r}" for p, r in LABELS) + " ELSE 4 END"


@query(
    "label_rank_top8",
    prelude("P", "C", "M") + f", U AS (SELECT 0 AS src, key, lat, lng, name, lower(name) AS cls FROM C UNION ALL SELECT 1, key, lat, lng, name, 'access' FROM P WHERE parking), L AS (SELECT m.id AS town, lower(p.name) AS text, {_ORDER} AS o, src, key FROM U p JOIN M m ON {_IN}), "
    "D AS (SELECT * FROM L QUALIFY row_number() OVER (PARTITION BY town, text ORDER BY o, src, key) = 1) SELECT town, text, CAST(row_number() OVER (PARTITION BY town ORDER BY o, src, key) AS INTEGER) AS rank FROM D QUALIFY rank <= 8",
)
def label_rank_top8(spark, sf):
    """Access points join the names; the first of each name is a map-side minimum, so the window sees names, not points."""
    names = view(spark, sf, "C").select(F.lit(0).alias("src"), "key", "lat", "lng", "name", F.lower("name").alias("cls"))
    access = view(spark, sf, "P").where("parking").select(F.lit(1).alias("src"), "key", "lat", "lng", "name", F.lit("access").alias("cls"))
    order = F.lit(4)
    for pattern, r in reversed(LABELS):
        order = F.when(F.col("cls").rlike(pattern), r).otherwise(order)
    inside = point_in_polygon(names.unionByName(access), towns(spark, sf).withColumnRenamed("name", "t_name"))
    first = inside.groupBy(F.col("id").alias("town"), F.lower("name").alias("text")).agg(F.min(F.struct(order.alias("o"), "src", "key")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("town").orderBy("at"))).where("rank <= 8").select("town", "text", "rank")


_KIND = "CASE key % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(PUBLIC)) + " ELSE 'other' END"


@query(
    "publics_top14",
    prelude("C", "M") + f", U AS (SELECT key, lat, lng, {_KIND} AS kind, CASE WHEN key % 9 BETWEEN 1 AND 7 THEN key % 9 ELSE 9 END AS o FROM C), G AS (SELECT m.id AS town, kind, o, key, CAST(floor(floor((p.lng - m.x0) / (m.x1 - m.x0) * 64) / 3 + 0.5) AS BIGINT) * 100 + CAST(floor(floor((p.lat - m.y0) / (m.y1 - m.y0) * 64) / 3 + 0.5) AS BIGINT) AS cell FROM U p JOIN M m ON {_IN}), "
    "D AS (SELECT * FROM G QUALIFY row_number() OVER (PARTITION BY town, cell ORDER BY o, key) = 1) SELECT town, kind, cell, CAST(row_number() OVER (PARTITION BY town ORDER BY o, key) AS INTEGER) AS rank FROM D QUALIFY rank <= 14",
)
def publics_top14(spark, sf):
    """One for each cell of three by three, 14 for each town. A kind of rank 0 sorts with the unknown ones, last."""
    at = F.pmod("key", F.lit(9))
    kind = F.coalesce(F.get(F.array(*[F.lit(k) for k in PUBLIC]), at.cast("int")), F.lit("other"))
    c = view(spark, sf, "C").select("key", "lat", "lng", kind.alias("kind"), F.when(at.between(1, 7), at).otherwise(9).alias("o"))
    inside = point_in_polygon(c, towns(spark, sf))
    third = lambda v, a, b: F.floor(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * 64) / 3 + 0.5)
    first = inside.groupBy(F.col("id").alias("town"), (third("lng", "x0", "x1") * 100 + third("lat", "y0", "y1")).alias("cell")).agg(F.min(F.struct("o", "key", "kind")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("town").orderBy("at"))).where("rank <= 14")
    return ranked.select("town", F.col("at.kind").alias("kind"), "cell", "rank")


@query("ring_parts")
def ring_parts(spark, sf):
    def parts(rings: pd.DataFrame) -> pd.DataFrame:
        rings = rings.sort_values("id")
        return pd.DataFrame({"place": rings["place"], "ring": rings["id"], "part": layers.ring_parts(rings)})

    b = boxes(spark, sf).withColumn("place", F.col("id") % 25).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return layers.by_group(b, "place", "place long, ring long, part long", parts)


@query("resample_path")
def resample_path(spark, sf):
    def points(path: pd.DataFrame) -> pd.DataFrame:
        made = layers.resample(path.sort_values("key")[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"path": path["path"].iloc[0], "n": range(len(made)), "x": made[:, 0], "y": made[:, 1]})

    o = view(spark, sf, "O").select("key", "path", ((F.col("lng") + 73.5) * 20).alias("x"), ((F.col("lat") - 41) * 20).alias("y"))
    return layers.by_group(o, "path", "path long, n long, x double, y double", points)
