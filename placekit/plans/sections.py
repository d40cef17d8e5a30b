"""Rows of the source sections, made of raw features that the star-schema tables give."""

from pyspark.sql import functions as F

from placekit.plans.adapter import _pick
from placekit.plans.registry import query
from placekit.sources import sections

# Attributes of the raw features, which give every rule something to match; null stands for an attribute that is missing.
ATTRIBUTES = {
    "name": _pick(["Fox Run", "Oak Hill ", None, "", "Mill Pond", "Elm Green"], "p_partkey"),
    "leisure": _pick(["park", "nature_reserve", "pitch", "playground", "garden"], "p_partkey"),
    "landuse": _pick(["forest", "cemetery", "village_green", "retail"], "(p_partkey + p_size)"),
    "tourism": _pick(["museum", "hotel"], "p_size"),
    "historic": _pick([None, "house", "mill"], "p_partkey"),
    "amenity": _pick(["parking", "bench"], "p_partkey"),
    "access": _pick([None, "yes", "private", None, "no", "customers", "permit"], "(p_partkey + 3 * p_size)"),
    "website": _pick(["http://a.test/x", None, "b.test", "https://c.test"], "p_size"),
    "operator": _pick(["Town of Elm", None, "Elm Trust"], "p_size"),
    "sport": _pick(["tennis", None], "p_size"),
    "Shape__Area": "CAST(p_size * 700 AS VARCHAR(20))",
    "water": _pick(["Pond", None, ""], "p_partkey"),
    "waterway": _pick([None, "River"], "p_partkey"),
    "AV_LEGEND": _pick(["Wildlife Area", "Flood Control", "State Park", "Fish Hatchery"], "p_size"),
    "PROPERTY": "concat('Land ', CAST(p_partkey % 40 AS VARCHAR(20)))",
    "ACRE_GIS": "CAST(p_size / 4.0 AS VARCHAR(20))",
    "ACCSS_NAME": _pick(["Upper Ramp", None, "", "lower ramp"], "p_partkey"),
    "CATEGORY": _pick(["FOREST", "ADMINISTRATIVE", " WILDLIFE ", None], "p_partkey"),
    "FACILITY": _pick(["Big Woods", " ", None, " Long Marsh"], "(p_partkey + p_size)"),
    "CLASS": _pick(["N/A", "WILD", "None", ""], "p_size"),
    "COUNTY": _pick(["Elm", "", None], "p_size"),
    "ACRES": _pick(["0", "12.6", None, "x"], "p_partkey"),
    "URL": _pick([" http://d.test", "d.test", None], "p_partkey"),
    "Unit_Nm": _pick([" Elm Wood", "Unknown", "", "Far Field"], "(p_partkey + p_size)"),
    "Own_Name": _pick(["CITY", "TRIB", None, ""], "p_size"),
    "Mang_Name": _pick(["CITY", "NGO", "TRIB"], "p_partkey"),
    "Pub_Access": _pick(["OA", "XA", "RA", None], "p_partkey"),
    "Des_Tp": _pick(["LP", None], "p_size"),
}
_FEATURES = (
    "SELECT p_partkey AS seq, "
    + ", ".join(f'{v} AS "{k}"' for k, v in ATTRIBUTES.items())
    + ", CASE WHEN p_partkey % 3 = 0 THEN -73.5 + (p_partkey % 50) / CAST(100.0 AS DOUBLE) END AS cx, CASE WHEN p_partkey % 3 = 0 THEN 41.0 + (p_partkey % 40) / CAST(100.0 AS DOUBLE) END AS cy"
    + ", CASE WHEN p_partkey % 3 = 1 THEN -73.5 + (p_partkey % 50) / CAST(100.0 AS DOUBLE) END AS x, CASE WHEN p_partkey % 3 = 1 THEN 41.0 + (p_partkey % 40) / CAST(100.0 AS DOUBLE) END AS y FROM part"
)


def raw(spark, sf):
    """Raw features: attributes that are there, and the one pair of places that a service gives, or none."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    place = [F.expr(f"CASE WHEN p_partkey % 3 = {r} THEN {v} END").alias(n) for n, r, v in (("cx", 0, "-73.5 + (p_partkey % 50) / CAST(100.0 AS DOUBLE)"), ("cy", 0, "41.0 + (p_partkey % 40) / CAST(100.0 AS DOUBLE)"), ("x", 1, "-73.5 + (p_partkey % 50) / CAST(100.0 AS DOUBLE)"), ("y", 1, "41.0 + (p_partkey % 40) / CAST(100.0 AS DOUBLE)"))]
    bag = F.map_filter(F.create_map(*[c for k, v in ATTRIBUTES.items() for c in (F.lit(k), F.expr(v).cast("string"))]), lambda _, v: v.isNotNull())
    return part.select(F.col("p_partkey").alias("seq"), bag.alias("attributes"), *place)


def _exact(df):
    """Places as whole numbers, so that two engines agree to the last bit."""
    return df.withColumns({c: F.floor(F.col(c) * 100000 + 0.5) for c in ("lat", "lng")})


_PLACED = "T AS (SELECT *, coalesce(cy, y) AS la, coalesce(cx, x) AS ln FROM F WHERE coalesce(cx, x) IS NOT NULL)"
_AT = "CAST(floor(la * 100000 + 0.5) AS BIGINT) AS lat, CAST(floor(ln * 100000 + 0.5) AS BIGINT) AS lng"
_OPEN = "(access IS NULL OR access NOT IN ('private', 'no'))"
_NAMED = "name IS NOT NULL AND name <> ''"
_WEB = "CASE WHEN website LIKE 'http%' THEN website END AS w"
_ACRES = 'CAST(floor(CAST("Shape__Area" AS DOUBLE) * cos(radians(la)) * cos(radians(la)) * 0.000247105 + 0.5) AS BIGINT)'


def _sql(select: str) -> str:
    return f"WITH F AS ({_FEATURES}), {_PLACED} {select}"


_SQL = {
    "state_extra": _sql(f"""SELECT "PROPERTY" AS n, t, a, lat, lng FROM (SELECT "PROPERTY", "AV_LEGEND" AS t, CAST(floor(CAST("ACRE_GIS" AS DOUBLE) + 0.5) AS BIGINT) AS a, {_AT}, row_number() OVER (PARTITION BY "PROPERTY" ORDER BY floor(CAST("ACRE_GIS" AS DOUBLE) + 0.5) DESC, seq) AS r FROM T WHERE "AV_LEGEND" <> 'State Park') WHERE r = 1 AND a >= 5"""),
    "boats": _sql(f"""SELECT n, town, w, trailer, carry, hc, url, lat, lng FROM (SELECT coalesce(nullif("ACCSS_NAME", ''), "PROPERTY") AS n, '' AS town, '' AS w, CAST(NULL AS VARCHAR) AS trailer, CAST(NULL AS VARCHAR) AS carry, CAST(NULL AS VARCHAR) AS hc, CAST(NULL AS VARCHAR) AS url, {_AT}, row_number() OVER (PARTITION BY lower(coalesce(nullif("ACCSS_NAME", ''), "PROPERTY")), floor(round(la, 5) * 2000 + 0.5), floor(round(ln, 5) * 2000 + 0.5) ORDER BY seq) AS r FROM T) WHERE r = 1"""),
    "agency_land": _sql(f"""SELECT trim("FACILITY") AS n, coalesce(trim("CATEGORY"), '') AS cat, CASE WHEN "CLASS" = 'WILD' THEN 'WILD' END AS cls, CASE WHEN coalesce(try_cast("ACRES" AS DOUBLE), 0) <> 0 THEN CAST(floor(try_cast("ACRES" AS DOUBLE) + 0.5) AS BIGINT) END AS a, nullif("COUNTY", '') AS county, CASE WHEN trim("URL") LIKE 'http%' THEN trim("URL") END AS url, {_AT} FROM T WHERE trim("FACILITY") <> '' AND coalesce(trim("CATEGORY"), '') <> 'ADMINISTRATIVE'"""),
    "town_parks": _sql(f"SELECT name AS n, {_AT}, CASE WHEN {_ACRES} >= 1 THEN {_ACRES} END AS a, {_WEB} FROM T WHERE leisure = 'park' AND {_NAMED} AND {_OPEN}"),
    "landuse": _sql(f"SELECT name AS n, landuse AS k, coalesce(operator, '') AS op, {_ACRES} AS a, {_AT} FROM T WHERE landuse IN ('recreation_ground', 'village_green', 'forest') AND {_NAMED} AND {_OPEN}"),
    "preserves": _sql(f"SELECT coalesce(name, '') AS n, coalesce(operator, '') AS op, {_WEB}, {_AT} FROM T WHERE leisure = 'nature_reserve' AND {_OPEN}"),
    "cemeteries": _sql(f"SELECT name AS n, {_WEB}, {_AT} FROM T WHERE landuse = 'cemetery' AND {_NAMED} AND {_OPEN}"),
    "museums": _sql(f"SELECT name AS n, historic AS h, coalesce(operator, '') AS op, {_WEB}, {_AT} FROM T WHERE tourism = 'museum' AND historic IS NOT NULL AND {_NAMED}"),
    "facilities": _sql(f"SELECT {_AT}, leisure, coalesce(sport, '') AS sport FROM T WHERE leisure IN ('pitch', 'playground') AND {_OPEN}"),
    "parking": _sql(f"SELECT {_AT} FROM T WHERE amenity = 'parking' AND (access IS NULL OR access NOT IN ('private', 'no', 'customers', 'permit'))"),
    "water": _sql(f"""SELECT lat, lng, name, CAST(floor(sqrt(area / pi()) + 0.5) AS BIGINT) AS radius, kind FROM (SELECT {_AT}, name, CAST("Shape__Area" AS DOUBLE) * cos(radians(la)) * cos(radians(la)) AS area, lower(coalesce(nullif(water, ''), nullif(waterway, ''), '')) AS kind FROM T WHERE {_NAMED}) WHERE area >= 2000"""),
    "protected": _sql(f"""SELECT trim("Unit_Nm") AS n, coalesce(nullif("Own_Name", ''), 'UNK') AS own, coalesce("Pub_Access", 'UK') AS acc, coalesce("Des_Tp", '') AS des, CAST(0 AS BIGINT) AS a, {_AT} FROM T WHERE "Unit_Nm" <> '' AND "Unit_Nm" <> 'Unknown' AND coalesce("Pub_Access", 'UK') <> 'XA' AND coalesce("Own_Name", '') <> 'TRIB' AND "Mang_Name" <> 'TRIB'"""),
}


def _register(name: str) -> None:
    @query(f"section_{name}", _SQL[name])
    def section(spark, sf):
        return _exact(sections.rows_of(raw(spark, sf), name))


for _name in sections.SECTIONS:
    _register(_name)


@query("point_of", f"WITH F AS ({_FEATURES}) SELECT seq, CAST(floor(coalesce(cy, y) * 100000 + 0.5) AS BIGINT) AS lat, CAST(floor(coalesce(cx, x) * 100000 + 0.5) AS BIGINT) AS lng FROM F")
def point_of(spark, sf):
    """The centroid if a service gives one, else the feature's own point, else none."""
    return _exact(raw(spark, sf).select("seq", sections.at("y").alias("lat"), sections.at("x").alias("lng")))


@query("access_allowed", f"WITH F AS ({_FEATURES}) SELECT seq, coalesce(access IS NULL OR access NOT IN ('private', 'no'), false) AS visit, coalesce(access IS NULL OR access NOT IN ('private', 'no', 'customers', 'permit'), false) AS park FROM F")
def access_allowed(spark, sf):
    """Missing access counts as allowed."""
    return raw(spark, sf).select("seq", sections.allowed(sections.SHUT).alias("visit"), sections.allowed(sections.SHUT_PARKING).alias("park"))
