"""Polygons, tiles, sample points and smoothing."""

from pyspark.sql import functions as F

from placekit.functions import geo
from placekit.plans.adapter import prelude, view
from placekit.plans.joins import _OC, gap_cells_in_towns, towns, trail_cells
from placekit.plans.registry import query


@query("polygon_stats", prelude("M") + "SELECT id, CAST(floor((x1 - x0) * (y1 - y0) * 1e8 + 0.5) AS BIGINT) AS area_e8, CAST(floor(greatest((y1 - y0) * 111000, (x1 - x0) * 111000 * cos(radians((y0 + y1) / 2)))) AS BIGINT) AS span_m, CAST(100 AS BIGINT) AS fill_pct, CAST(floor((3 * x0 + 2 * x1) / 5 * 1e4) AS BIGINT) AS cx_e4 FROM M")
def polygon_stats(spark, sf):
    m = towns(spark, sf)
    area = F.abs(geo.shoelace(F.col("ring")))
    span = F.greatest((F.col("y1") - F.col("y0")) * 111000, (F.col("x1") - F.col("x0")) * 111000 * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2)))
    fill = F.floor(100 * area / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) + 0.5)
    cx = F.aggregate("ring", F.lit(0.0), lambda s, v: s + v["x"]) / F.size("ring")
    return m.select("id", F.floor(area * 1e8 + 0.5).alias("area_e8"), F.floor(span).alias("span_m"), fill.alias("fill_pct"), F.floor(cx * 1e4).alias("cx_e4"))


@query("district_reject_reason", prelude("M") + "SELECT CASE WHEN regexp_matches(name, '3$') THEN 'amendment' WHEN id % 5 = 0 THEN 'route' WHEN (y1 - y0) * 111 > 9.98 AND id % 2 = 0 THEN 'oversized' ELSE 'kept' END AS reason, count(*) AS n FROM M GROUP BY 1")
def district_reject_reason(spark, sf):
    reason = F.when(F.col("name").rlike("3$"), "amendment").when(F.col("id") % 5 == 0, "route").when(((F.col("y1") - F.col("y0")) * 111 > 9.98) & (F.col("id") % 2 == 0), "oversized").otherwise("kept")
    return view(spark, sf, "M").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("area_by_layer_name", prelude("M") + "SELECT layer, substr(name, 1, 8) AS stem, CAST(floor(sum((x1 - x0) * (y1 - y0)) * 1e6 + 0.5) AS BIGINT) AS area_e6, count(*) AS parts FROM M GROUP BY 1, 2")
def area_by_layer_name(spark, sf):
    m = towns(spark, sf).withColumn("a", F.abs(geo.shoelace(F.col("ring"))))
    return m.groupBy("layer", F.substring("name", 1, 8).alias("stem")).agg(F.floor(F.sum("a") * 1e6 + 0.5).alias("area_e6"), F.count(F.lit(1)).alias("parts"))


_Z = ", (SELECT unnest(range(6, 13)) AS z)"
_TX = "CAST(floor(({c} + 180) / 360 * power(2, z)) AS BIGINT)"
_TY = "CAST(floor((1 - ln(tan(radians({c})) + 1 / cos(radians({c}))) / pi()) / 2 * power(2, z)) AS BIGINT)"


@query("mercator_tile_xy", prelude("P") + f"SELECT key, CAST(z AS INTEGER) AS z, {_TX.format(c='lng')} AS tx, {_TY.format(c='lat')} AS ty FROM P, (SELECT unnest([6, 10, 14]) AS z)")
def mercator_tile_xy(spark, sf):
    p = view(spark, sf, "P").select("key", "lat", "lng", F.explode(F.array(*[F.lit(z) for z in (6, 10, 14)])).alias("z"))
    return p.select("key", "z", F.floor(geo.tile_x(F.col("lng"), F.col("z"))).alias("tx"), F.floor(geo.tile_y(F.col("lat"), F.col("z"))).alias("ty"))


def _zooms(df, lo: int = 6, hi: int = 12):
    return df.withColumn("z", F.explode(F.sequence(F.lit(lo), F.lit(hi))))


def covered(spark, sf):
    m = _zooms(view(spark, sf, "M"))
    z = F.col("z")
    m = m.withColumn("x", F.explode(F.sequence(F.floor(geo.tile_x(F.col("x0"), z)), F.floor(geo.tile_x(F.col("x1"), z)))))
    return m.withColumn("y", F.explode(F.sequence(F.floor(geo.tile_y(F.col("y1"), z)), F.floor(geo.tile_y(F.col("y0"), z)))))


_COVER = f"T AS (SELECT id, layer, z, x, unnest(range(ya, yb + 1)) AS y FROM (SELECT id, layer, z, unnest(range({_TX.format(c='x0')}, {_TX.format(c='x1')} + 1)) AS x, {_TY.format(c='y1')} AS ya, {_TY.format(c='y0')} AS yb FROM M{_Z}))"


@query("tile_cover", prelude("M") + f", {_COVER} SELECT CAST(z AS INTEGER) AS z, x, y, count(*) AS n FROM T GROUP BY z, x, y")
def tile_cover(spark, sf):
    return covered(spark, sf).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("tile_feature_counts", prelude("M") + f", {_COVER} SELECT CAST(z AS INTEGER) AS z, x, y, layer, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM T GROUP BY z, x, y, layer")
def tile_feature_counts(spark, sf):
    ids = F.array_sort(F.collect_list("id"))
    return covered(spark, sf).groupBy("z", "x", "y", "layer").agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query("zoom_area_filter", prelude("M") + f", X AS (SELECT layer, z, (x1 - x0) * (y1 - y0) * (1 + layer) / 50 AS a, 360.0 / power(2, z) / 512 AS px FROM M{_Z}) SELECT CAST(z AS INTEGER) AS z, layer, count(*) AS n FROM X WHERE a >= 0.25 * px * px AND z >= 6 + layer GROUP BY z, layer")
def zoom_area_filter(spark, sf):
    m = _zooms(view(spark, sf, "M"))
    px = 360.0 / F.pow(F.lit(2.0), F.col("z")) / 512
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (1 + F.col("layer")) / 50
    return m.where((F.col("z") >= 6 + F.col("layer")) & (area >= 0.25 * px * px)).groupBy("z", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("sample_ring_points", prelude("P") + ", X AS (SELECT key, lat, lng, acres, unnest(range(0, 9)) AS i, CASE WHEN coalesce(acres, 0) <= 0 THEN 120 ELSE least(2200, greatest(90, sqrt(acres * 4047 / pi()))) END AS r FROM P) SELECT key, CAST(i AS INTEGER) AS i, CAST(floor((lat + CASE WHEN i = 0 THEN 0 ELSE sin(radians(45 * (i - 1))) * r * CASE WHEN i % 2 = 0 THEN 0.55 ELSE 0.85 END / 111320 END) * 10000) AS BIGINT) AS lat_e4 FROM X WHERE i = 0 OR coalesce(acres, 0) >= 5")
def sample_ring_points(spark, sf):
    p = view(spark, sf, "P").select("key", "lat", "acres", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).where("i = 0 OR coalesce(acres, 0) >= 5")
    step = F.sin(F.radians(45 * (F.col("i") - 1))) * geo.radius_m(F.col("acres")) * F.when(F.col("i") % 2 == 0, 0.55).otherwise(0.85) / 111320
    return p.select("key", "i", F.floor((F.col("lat") + F.when(F.col("i") == 0, 0.0).otherwise(step)) * 10000).alias("lat_e4"))


@query("region_clip_boxes", prelude("M") + "SELECT id, CASE WHEN x0 >= -73.42 AND x1 <= -73.08 THEN 'kept' WHEN x1 <= -73.42 OR x0 >= -73.08 THEN 'dropped' ELSE 'cut' END AS how, CAST(floor(greatest(0, least(x1, -73.08) - greatest(x0, -73.42)) * 1e6 + 0.5) AS BIGINT) AS width_e6 FROM M")
def region_clip_boxes(spark, sf):
    lo, hi, x0, x1 = -73.42, -73.08, F.col("x0"), F.col("x1")
    how = F.when((x0 >= lo) & (x1 <= hi), "kept").when((x1 <= lo) | (x0 >= hi), "dropped").otherwise("cut")
    return view(spark, sf, "M").select("id", how.alias("how"), F.floor(F.greatest(F.lit(0.0), F.least(x1, F.lit(hi)) - F.greatest(x0, F.lit(lo))) * 1e6 + 0.5).alias("width_e6"))


@query("prop_clean", "SELECT event_id, k, v FROM (SELECT event_id, 'type' AS k, trim(event_type) AS v FROM events UNION ALL SELECT event_id, 'props', substr(trim(props), 1, 8) FROM events UNION ALL SELECT event_id, 'blank', CASE WHEN user_id % 2 = 0 THEN ' ' ELSE NULL END FROM events) WHERE v IS NOT NULL AND trim(v) <> ''")
def prop_clean(spark, sf):
    from placekit.sources.files import clean_properties

    e = spark.read.parquet(f"{sf}/events.parquet")
    bag = F.create_map(F.lit("type"), "event_type", F.lit("props"), F.col("props"), F.lit("blank"), F.when(F.col("user_id") % 2 == 0, " "))
    return e.select("event_id", F.explode(clean_properties(bag, 8)).alias("k", "v"))


@query("prop_clean_120", "SELECT event_id, k, v FROM (SELECT event_id, 'type' AS k, substr(trim(event_type), 1, 120) AS v FROM events UNION ALL SELECT event_id, 'props', substr(trim(props), 1, 120) FROM events UNION ALL SELECT event_id, 'long', substr(repeat(trim(props), 20), 1, 120) FROM events) WHERE v IS NOT NULL AND v <> ''")
def prop_clean_120(spark, sf):
    """Values cut at 120 characters; one property is long enough for it."""
    from placekit.sources.files import clean_properties

    e = spark.read.parquet(f"{sf}/events.parquet")
    bag = F.create_map(F.lit("type"), "event_type", F.lit("props"), F.col("props"), F.lit("long"), F.repeat(F.trim("props"), 20))
    return e.select("event_id", F.explode(clean_properties(bag)).alias("k", "v"))


def clusters(cells):
    """8-connected groups of four cells or more: neighbours meet in cell joins, groups by contracting stars."""
    from placekit.operators.components import connected_components

    cells = cells.withColumn("id", F.col("ci") * 1000000 + F.col("cj") + 500000)
    step = F.explode(F.array(*[F.lit(d) for d in (1, 999999, 1000000, 1000001)]))
    edges = cells.select("id", step.alias("d")).select(F.col("id").alias("a"), (F.col("id") + F.col("d")).alias("b"))
    edges = edges.join(cells.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    groups = connected_components(edges).join(cells.withColumnRenamed("id", "node"), "node")
    sums = groups.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.floor(F.avg("ci")).alias("ci_mean"), F.floor(F.avg("cj")).alias("cj_mean"))
    return sums.where("size >= 4")


@query("gap_clusters")
def gap_clusters(spark, sf):
    """Groups of all trail cells."""
    return clusters(trail_cells(spark, sf))


@query("gap_clusters_in_towns")
def gap_clusters_in_towns(spark, sf):
    """Groups of the trail cells that no place holds and that lie in a town; read twice, so kept once."""
    from placekit.operators.components import materialize

    return clusters(materialize(gap_cells_in_towns(spark, sf)))


@query("chaikin_smooth", prelude("M") + ", V AS (SELECT id, x0, x1, y0, y1 FROM M) SELECT id, CAST(floor(sum(x) * 1e5) AS BIGINT) AS sum_x_e5, count(*) AS n FROM (SELECT id, unnest([0.75 * x0 + 0.25 * x1, 0.25 * x0 + 0.75 * x1, x1, x1, 0.75 * x1 + 0.25 * x0, 0.25 * x1 + 0.75 * x0, x0, x0]) AS x FROM V) GROUP BY id")
def chaikin_smooth(spark, sf):
    """One pass of corner cutting: each edge gives the points at a quarter and three quarters."""
    mix = lambda a, b, t: F.struct((a["x"] * (1 - t) + b["x"] * t).alias("x"), (a["y"] * (1 - t) + b["y"] * t).alias("y"))
    edges = F.sequence(F.lit(1), F.size("ring") - 1)
    cut = F.flatten(F.transform(edges, lambda i: F.array(mix(F.element_at("ring", i), F.element_at("ring", i + 1), 0.25), mix(F.element_at("ring", i), F.element_at("ring", i + 1), 0.75))))
    m = towns(spark, sf).select("id", cut.alias("cut"))
    return m.select("id", F.floor(F.aggregate("cut", F.lit(0.0), lambda s, v: s + v["x"]) * 1e5).alias("sum_x_e5"), F.size("cut").cast("long").alias("n"))
