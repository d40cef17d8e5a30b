"""Scans of a viewer: what lies in view, grids of samples, elements by what they are, levels of tiles, sentences of a card."""

from pyspark.sql import functions as F

from placekit.functions import geo, names
from placekit.plans.adapter import prelude, view
from placekit.plans.registry import query
from placekit.sources.remote import in_view

# A view, metres of a degree, kinds of public buildings, spans in metres from which tiles of a level do.
VIEW, ZOOM = (-73.4, 41.1, -73.1, 41.35), 12
LAT, LNG = 110574.0, 111320.0
PUBLIC = ["library", "townhall", "museum"]
LEVELS = [(6000, 12), (3000, 13), (1200, 14)]


@query("viewport_shapes", prelude("R") + f" SELECT key, name FROM R WHERE lng BETWEEN {VIEW[0]} AND {VIEW[2]} AND lat BETWEEN {VIEW[1]} AND {VIEW[3]}")
def viewport_shapes(spark, sf):
    """Shapes in view; none where the view is too far away to draw them."""
    return in_view(view(spark, sf, "R"), VIEW, ZOOM).select("key", "name")


@query("terrain_points", prelude("P") + f", G AS (SELECT key, lat, lng, least(2200.0, greatest(90.0, sqrt(coalesce(acres, 0) * 4047.0 / pi()))) * 0.8 AS r, acres FROM P), R AS (SELECT key, lat, lng, CASE WHEN coalesce(acres, 0) <= 0 THEN 120.0 * 0.8 ELSE r END AS r FROM G) SELECT key, CAST(i AS INTEGER) AS i, CAST(floor((lat + (floor(i / 3) - 1) * r / {LAT}) * 10000) AS BIGINT) AS lat_e4, CAST(floor((lng + (i % 3 - 1) * r / ({LNG} * cos(radians(lat)))) * 10000) AS BIGINT) AS lng_e4 FROM R, (SELECT unnest(range(9)) AS i)")
def terrain_points(spark, sf):
    """Three by three points over a place, as far apart as it is large."""
    r = geo.radius_m(F.col("acres")) * 0.8
    p = view(spark, sf, "P").select("key", "lat", "lng", r.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    lat = F.col("lat") + (F.floor(F.col("i") / 3) - 1) * F.col("r") / LAT
    lng = F.col("lng") + (F.col("i") % 3 - 1) * F.col("r") / (LNG * F.cos(F.radians("lat")))
    return p.select("key", "i", F.floor(lat * 10000).alias("lat_e4"), F.floor(lng * 10000).alias("lng_e4"))


_TAGS = "CASE key % 11 WHEN 0 THEN 'library' WHEN 1 THEN 'parking' WHEN 2 THEN 'townhall' END"


@query(
    "elements_by_kind",
    prelude("C") + f", E AS (SELECT key, {_TAGS} AS amenity, CASE WHEN key % 3 = 0 THEN 'yes' END AS building, CASE WHEN key % 4 = 1 THEN 'service' END AS highway FROM C), K AS (SELECT key, 'public' AS kind FROM E WHERE amenity IN ('library', 'townhall', 'museum') UNION ALL "
    "SELECT key, CASE WHEN building IS NOT NULL THEN 'building' WHEN amenity = 'parking' THEN 'parking' WHEN highway IS NOT NULL THEN 'road' END FROM E WHERE amenity IS NULL OR amenity NOT IN ('library', 'townhall', 'museum') OR building IS NOT NULL) SELECT key, kind FROM K WHERE kind IS NOT NULL",
)
def elements_by_kind(spark, sf):
    """One scan of elements dealt by what they are: a public building is both a mark and, if it has walls, a building."""
    e = view(spark, sf, "C").select("key", F.expr(_TAGS).alias("amenity"), F.when(F.col("key") % 3 == 0, "yes").alias("building"), F.when(F.col("key") % 4 == 1, "service").alias("highway"))
    public = F.coalesce(F.col("amenity").isin(*PUBLIC), F.lit(False))
    other = F.when(~public | F.col("building").isNotNull(), F.when(F.col("building").isNotNull(), "building").when(F.col("amenity") == "parking", "parking").when(F.col("highway").isNotNull(), "road"))
    return e.select("key", F.explode(F.array_compact(F.array(F.when(public, "public"), other))).alias("kind"))


@query("tile_levels", prelude("P") + ", S AS (SELECT key, sqrt(coalesce(acres, 60) * 4046.86) * 1.6 AS span FROM P) SELECT key, CAST(CASE WHEN span > 6000 THEN 12 WHEN span > 3000 THEN 13 WHEN span > 1200 THEN 14 ELSE 15 END AS INTEGER) AS level FROM S")
def tile_levels(spark, sf):
    """The level of tiles that a scene of that span is sampled from."""
    span, level = F.sqrt(F.coalesce(F.col("acres"), F.lit(60)) * 4046.86) * 1.6, F.lit(15)
    for least, z in reversed(LEVELS):
        level = F.when(span > least, z).otherwise(level)
    return view(spark, sf, "P").select("key", level.alias("level"))


# Sports that have a court of their own, in the order in which a text is searched for them.
COURTS = [("tennis", 2), ("baseball", 3), ("basketball", 4), ("soccer", 5)]


@query("court_codes", prelude("C") + " SELECT key, CAST(CASE " + " ".join(f"WHEN sport LIKE '%{s}%' THEN {c}" for s, c in COURTS) + " ELSE 1 END AS INTEGER) AS code FROM C WHERE sport IS NOT NULL")
def court_codes(spark, sf):
    """The court that a field's sports draw: the first on the list, else a plain field."""
    code = F.lit(1)
    for sport, c in reversed(COURTS):
        code = F.when(F.col("sport").contains(sport), c).otherwise(code)
    return view(spark, sf, "C").where("sport IS NOT NULL").select("key", code.alias("code"))


@query(
    "place_sentences",
    prelude("P") + ", B AS (SELECT key, name, town, op, CASE WHEN acres >= 1000 THEN concat(CAST(CAST(floor(acres / 100.0 + 0.5) * 100 AS BIGINT) AS VARCHAR), ' acres') WHEN acres > 0 THEN concat(CAST(acres AS VARCHAR), ' acres') END AS size, type FROM P) "
    "SELECT key, concat(name, ', in town ', CAST(town AS VARCHAR), '.', coalesce(concat(' ', concat_ws(', ', size, type)), ''), coalesce(', kept by ' || op, ''), '.') AS told FROM B WHERE name IS NOT NULL",
)
def place_sentences(spark, sf):
    """Who and where, how large, of what kind and who keeps it; what isn't known isn't said."""
    size = F.when(F.col("acres") >= 1000, F.concat((F.floor(F.col("acres") / 100.0 + 0.5) * 100).cast("string"), F.lit(" acres"))).when(F.col("acres") > 0, F.concat(F.col("acres").cast("string"), F.lit(" acres")))
    told = F.concat("name", F.lit(", in town "), F.col("town").cast("string"), F.lit(". "), F.concat_ws(", ", size, "type"), F.coalesce(F.concat(F.lit(", kept by "), F.col("op")), F.lit("")), F.lit("."))
    return view(spark, sf, "P").where("name IS NOT NULL").select("key", told.alias("told"))


@query("fee_sentences", prelude("P") + " SELECT key, CASE WHEN type = 'state' AND state = 'CT' THEN 'cars of the state park free' WHEN fee IS NOT NULL THEN concat(fee, coalesce(' - ' || op, '')) ELSE op END AS told FROM P")
def fee_sentences(spark, sf):
    """What a card says about fees: a state's own rule in that state alone, else what is on record, else who keeps the place."""
    own = (F.col("type") == "state") & (F.col("state") == "CT")
    told = F.when(own, "cars of the state park free").when(F.col("fee").isNotNull(), F.concat("fee", F.coalesce(F.concat(F.lit(" - "), F.col("op")), F.lit("")))).otherwise(F.col("op"))
    return view(spark, sf, "P").select("key", told.alias("told"))


@query("town_parks_joined", prelude("C", "M") + " SELECT c.key, m.id AS town FROM C c JOIN M m ON c.lng > m.x0 AND c.lng <= m.x1 AND c.lat > m.y0 AND c.lat <= m.y1 QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(c.name), '[^a-z0-9]+', ' ', 'g')), floor(c.lat * 500 + 0.5), floor(c.lng * 500 + 0.5) ORDER BY c.key) = 1")
def town_parks_joined(spark, sf):
    """Parks by the town that holds them, the first of each name and cell of 1/500 degree; those outside all towns are left out."""
    from placekit.operators.spatial import point_in_polygon
    from placekit.plans.joins import towns

    c = view(spark, sf, "C").select("key", "lat", "lng", "name")
    held = point_in_polygon(c, towns(spark, sf).withColumnRenamed("name", "t_name"))
    spot = [names.norm(F.col("name")).alias("nm"), F.floor(F.col("lat") * 500 + 0.5).alias("i"), F.floor(F.col("lng") * 500 + 0.5).alias("j")]
    return held.groupBy(*spot).agg(F.min(F.struct("key", F.col("id").alias("town"))).alias("f")).select("f.key", "f.town")
