"""Gates of names, kinds of operators, fees, shapes of districts and the union of all sources, over wordings outside the tables."""

from pyspark.sql import functions as F

from placekit.functions import names, rules
from placekit.operators.spatial import first_by
from placekit.plans.adapter import prelude, view
from placekit.plans.registry import query
from placekit.plans.sections import _FEATURES, raw
from placekit.sources import sections

_R = rules.DEFAULT
# Own wordings to test the rules with; places take them in turn.
WORDS = [
    "Lake Elm Association", "Elm Rod & Gun", "Elm Homeowners Green", "HOA Field", "Elm Yacht Club", "Longshore Club Park", "Elm Sportsmen's Land", "Fish and Game Woods", "Scout Hill", "Scouting Hill",
    "Elm Holdings LLC", "Elm Associates Woods", "Elm Estates", "Elm Realty Park", "Elm Inc.", "Incline Park", "<b>Elm</b>", "ArrayOfThings", "--", "ab", "Elm State Park", "National Historical Elm", "Scenic Reserve Elm",
    "Pequot Burial Ground", "Mohegan Hill", "Reservation of the Indian", "Town of Elm", "Private Land", "unknown", "State of Elm", "12 Elm Lane", "Elm Subdivision Open Space", "Elm LP", "Elm Development", "Developments Park", "Quiet Woods",
]
OPERATORS = ["Connecticut DEP", "DEEP", "deeply", "U.S. Fish", "Army Corps of Engineers", "Aquarion", "Bureau of Water", "City Parks", "Elm Parks and Recreation", "Village of Elm", "Elm Academy", "Elm Audubon", "The Trust", "Trustees", "", None, "Somebody"]
FEES = ["free", "Free admission", "admission fee $5", "free, parking fee applies", "$12 parking", "$12", "ticket at the gate", "tickets", "Passport to the Parks", "per vehicle $9", "free for members, entry fee else", "entrance fee, children free", None]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_W = f"W AS (SELECT key, type, state, list_extract({_list(WORDS)}, CAST(key % {len(WORDS)} AS INT) + 1) AS word, list_extract({_list(OPERATORS)}, CAST(key % {len(OPERATORS)} AS INT) + 1) AS oper, list_extract({_list(FEES)}, CAST(key % {len(FEES)} AS INT) + 1) AS cost, list_extract({_list(FEES)}, CAST(floor(key / 13) AS INT) % {len(FEES)} + 1) AS remark FROM P)"


def worded(spark, sf):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values)).cast("int") + 1)
    k = F.col("key")
    return view(spark, sf, "P").select("key", "type", "state", pick(WORDS, k).alias("word"), pick(OPERATORS, k).alias("oper"), pick(FEES, k).alias("cost"), pick(FEES, F.floor(k / 13)).alias("remark"))


def _says(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches(lower({c}), '{pattern}'), false)"


_REFUSAL = (
    f"CASE WHEN length(trim(coalesce(word, ''))) < 3 THEN 'short' WHEN {_says('word', _R.junk)} THEN 'junk' WHEN lower(word) IN ({', '.join(repr(a) for a in _R.allow)}) THEN NULL WHEN {_says('word', _R.members)} THEN 'members' "
    f"WHEN {_says('word', _R.company)} THEN 'company' WHEN state = 'CT' AND {_says('word', _R.covered)} THEN 'covered' END"
)


@query("name_refusals", prelude("P") + f", {_W} SELECT key, word, {_REFUSAL} AS refusal, {_says('word', _R.tribal)} AS tribal, {_says('word', _R.generic)} AS generic, {_says('word', _R.parcel)} AS parcel FROM W")
def name_refusals(spark, sf):
    """Why a name is refused, and what else it says."""
    w = F.col("word")
    return worded(spark, sf).select("key", "word", rules.refusal(w, F.col("state")).alias("refusal"), rules.says(w, _R.tribal).alias("tribal"), rules.says(w, _R.generic).alias("generic"), rules.says(w, _R.parcel).alias("parcel"))


@query("operator_kinds", prelude("P") + f", {_W} SELECT key, CASE WHEN coalesce(trim(oper), '') = '' THEN 'none' " + " ".join(f"WHEN {_says('oper', p)} THEN '{k}'" for k, p in _R.operators) + " ELSE 'other' END AS kind FROM W")
def operator_kinds(spark, sf):
    return worded(spark, sf).select("key", rules.operator_kind(F.col("oper")).alias("kind"))


@query("preserve_classes", prelude("P") + f", {_W} SELECT key, CASE WHEN {_says('oper', _R.operators[1][1])} THEN 'national' WHEN {_says('oper', _R.operators[0][1])} OR {_says('oper', _R.operators[2][1])} THEN NULL WHEN {_says('oper', _R.operators[3][1])} THEN 'town' ELSE 'preserve' END AS type, CASE WHEN {_says('word', _R.generic)} THEN concat(coalesce(nullif(trim(regexp_replace(oper, ',? Inc\\.?$', '')), ''), 'Unnamed'), ' land') ELSE word END AS name FROM W")
def preserve_classes(spark, sf):
    """The type of a preserve by who runs it, federal first; state and water land has layers of its own. A name that says nothing becomes its operator's land."""
    o, kinds = F.col("oper"), dict(_R.operators)
    kind = F.when(rules.says(o, kinds["federal"]), "national").when(rules.says(o, kinds["state"]) | rules.says(o, kinds["water"]), F.lit(None).cast("string")).when(rules.says(o, kinds["town"]), "town").otherwise("preserve")
    owner = F.trim(F.regexp_replace(o, r",? Inc\.?$", ""))
    name = F.when(rules.says(F.col("word"), _R.generic), F.concat(F.coalesce(F.when(owner != "", owner), F.lit("Unnamed")), F.lit(" land"))).otherwise(F.col("word"))
    return worded(spark, sf).select("key", kind.alias("type"), name.alias("name"))


_TEXT = "lower(concat(coalesce(cost, ''), ' ', coalesce(remark, '')))"


@query(
    "fee_states",
    prelude("P") + f", {_W}, T AS (SELECT key, type, {_TEXT} AS t FROM W), U AS (SELECT key, type, regexp_matches(t, '\\bfree\\b') AND NOT regexp_matches(regexp_replace(t, '^.*\\bfree\\b', ''), '\\b(fee|charge)\\b') AS free, regexp_matches(t, '{_R.charge}') OR (regexp_matches(t, '\\$\\d') AND NOT contains(regexp_replace(t, '^.*\\$\\d', ''), 'parking')) AS paid, regexp_matches(t, '{_R.parking_charge}') AS park FROM T) "
    "SELECT key, CASE WHEN paid AND NOT free THEN 'paid' WHEN park THEN 'parking' WHEN free THEN 'free' WHEN type = 'state' THEN 'parking' ELSE 'free' END AS fee FROM U",
)
def fee_states(spark, sf):
    """What a place costs, by its fee and its note."""
    return worded(spark, sf).select("key", rules.fee_of(F.col("cost"), F.col("remark"), F.col("type")).alias("fee"))


@query("parking_flag_reuse_300", prelude("P", "C") + ", N AS (SELECT key, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS nm, lat + (key % 3) / CAST(4000.0 AS DOUBLE) AS la, lng AS ln, parking FROM P), D AS (SELECT key, nm, CAST(floor(la * 300 + 0.5) AS BIGINT) AS i, CAST(floor(ln * 300 + 0.5) AS BIGINT) AS j, parking FROM N), B AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS nm, CAST(floor(lat * 300 + 0.5) AS BIGINT) AS i, CAST(floor(lng * 300 + 0.5) AS BIGINT) AS j FROM P WHERE key % 2 = 0) SELECT key FROM D WHERE NOT parking AND EXISTS (SELECT 1 FROM B WHERE B.nm = D.nm AND B.i = D.i AND B.j = D.j)")
def parking_flag_reuse_300(spark, sf):
    """Places whose name and cell of 1/300 degree had parking in an earlier build, in which they stood a little elsewhere."""
    cells = lambda la, ln: [F.floor(la * 300 + 0.5).alias("i"), F.floor(ln * 300 + 0.5).alias("j")]
    p = view(spark, sf, "P").withColumn("nm", names.norm(F.col("name")))
    now = p.where("NOT parking").select("key", "nm", *cells(F.col("lat") + (F.col("key") % 3) / F.lit(4000.0), F.col("lng")))
    return now.join(p.where("key % 2 = 0").select("nm", *cells(F.col("lat"), F.col("lng"))), ["nm", "i", "j"], "left_semi").select("key")


_KIND = "CASE key % 4 WHEN 0 THEN 'Elm (Boundary Increase)' WHEN 1 THEN 'Old March Route' ELSE name END"


@query(
    "district_rejects",
    prelude("C") + f", S AS (SELECT key, lower({_KIND}) AS n, lat, 0.001 * (1 + key % 90) AS wide, 0.0004 * (1 + key % 17) AS high FROM C), G AS (SELECT key, n, wide * 111.32 * cos(radians(lat + high / 2)) AS w, high * 111.32 AS h FROM S) "
    "SELECT key, CASE WHEN n LIKE '%boundary increase%' OR n LIKE '%boundary decrease%' THEN 'amendment' WHEN n LIKE '%march route%' THEN 'route' WHEN greatest(w, h) > 8 THEN 'oversized' WHEN greatest(w, h) > 1.5 AND CASE WHEN key % 3 = 0 THEN 0.5 WHEN key % 3 = 1 THEN 0.08 ELSE 1.0 END < 0.15 THEN 'corridor' END AS reason FROM G",
)
def district_rejects(spark, sf):
    """Why a listing is no district: its name, its span, or how little of its box it fills."""
    n = F.lower(F.expr(_KIND))
    wide, high = 0.001 * (1 + F.col("key") % 90), 0.0004 * (1 + F.col("key") % 17)
    c = view(spark, sf, "C").select("key", "lat", "lng", n.alias("n"), wide.alias("wide"), high.alias("high"))
    # a triangle, a strip along the box's edges, or the whole box
    x, y, w, h = F.col("lng"), F.col("lat"), F.col("wide"), F.col("high")
    at = lambda a, b: F.struct((x + a * w).alias("x"), (y + b * h).alias("y"))
    ring = F.when(F.col("key") % 3 == 0, F.array(at(0, 0), at(1, 0), at(0, 1), at(0, 0))).when(F.col("key") % 3 == 1, F.array(at(0, 0), at(1, 0), at(1, 1), at(1 - 0.04 / 0.96, 0.04), at(0, 0.04), at(0, 0))).otherwise(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)))
    return _judged(c.withColumn("ring", ring))


def _judged(c):
    """key, reason of rows with a name ``n`` and a ring of x and y."""
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    kx = 111.32 * F.cos(F.radians((y0 + y1) / 2))
    cross = lambda i: F.element_at("ring", i)["x"] * F.element_at("ring", i + 1)["y"] - F.element_at("ring", i + 1)["x"] * F.element_at("ring", i)["y"]
    size = F.abs(F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, i: s + cross(i))) / 2
    span, fill = F.greatest((x1 - x0) * kx, (y1 - y0) * 111.32), size / ((x1 - x0) * (y1 - y0))
    n = F.col("n")
    reason = F.when(n.contains("boundary increase") | n.contains("boundary decrease"), "amendment").when(n.contains("march route"), "route").when(span > 8, "oversized").when((span > 1.5) & (fill < 0.15), "corridor")
    return c.select("key", reason.alias("reason"))


# The sections that give places, in the order in which they win, with the type of their places.
SOURCES = [("state_extra", "state"), ("boats", "state"), ("agency_land", "state"), ("town_parks", "town"), ("landuse", "town"), ("preserves", "preserve"), ("cemeteries", "cemetery"), ("museums", "preserve"), ("protected", "preserve")]
_ROWS = {
    "state_extra": """SELECT seq, n, la, ln FROM (SELECT seq, "PROPERTY" AS n, la, ln, CAST("ACRE_GIS" AS DOUBLE) AS a, row_number() OVER (PARTITION BY "PROPERTY" ORDER BY floor(CAST("ACRE_GIS" AS DOUBLE) + 0.5) DESC, seq) AS r FROM T WHERE "AV_LEGEND" <> 'State Park') WHERE r = 1 AND floor(a + 0.5) >= 5""",
    "boats": """SELECT seq, coalesce(nullif("ACCSS_NAME", ''), "PROPERTY") AS n, la, ln FROM T""",
    "agency_land": """SELECT seq, trim("FACILITY") AS n, la, ln FROM T WHERE trim("FACILITY") <> '' AND coalesce(trim("CATEGORY"), '') <> 'ADMINISTRATIVE'""",
    "town_parks": "SELECT seq, name AS n, la, ln FROM T WHERE leisure = 'park' AND name <> '' AND (access IS NULL OR access NOT IN ('private', 'no'))",
    "landuse": "SELECT seq, name AS n, la, ln FROM T WHERE landuse IN ('village_green', 'forest') AND name <> '' AND (access IS NULL OR access NOT IN ('private', 'no'))",
    "preserves": "SELECT seq, coalesce(name, '') AS n, la, ln FROM T WHERE leisure = 'nature_reserve' AND (access IS NULL OR access NOT IN ('private', 'no'))",
    "cemeteries": "SELECT seq, name AS n, la, ln FROM T WHERE landuse = 'cemetery' AND name <> '' AND (access IS NULL OR access NOT IN ('private', 'no'))",
    "museums": "SELECT seq, name AS n, la, ln FROM T WHERE tourism = 'museum' AND historic IS NOT NULL AND name <> ''",
    "protected": """SELECT seq, trim("Unit_Nm") AS n, la, ln FROM T WHERE "Unit_Nm" <> '' AND "Unit_Nm" <> 'Unknown' AND coalesce("Pub_Access", 'UK') <> 'XA' AND coalesce("Own_Name", '') <> 'TRIB' AND "Mang_Name" <> 'TRIB'""",
}


@query(
    "sources_united",
    f"WITH F AS ({_FEATURES}), T AS (SELECT *, round(coalesce(cy, y), 5) AS la, round(coalesce(cx, x), 5) AS ln FROM F WHERE coalesce(cx, x) IS NOT NULL), U AS (" + " UNION ALL ".join(f"SELECT {i} AS source, '{kind}' AS type, * FROM ({_ROWS[s]})" for i, (s, kind) in enumerate(SOURCES)) + "), "
    "K AS (SELECT *, lower(trim(n)) AS nm, CAST(floor(la * 300 + 0.5) AS BIGINT) AS i, CAST(floor(ln * 300 + 0.5) AS BIGINT) AS j FROM U WHERE length(trim(n)) >= 3) "
    "SELECT type, nm, i, j, source FROM K QUALIFY row_number() OVER (PARTITION BY nm, i, j ORDER BY source, seq) = 1",
)
def sources_united(spark, sf):
    """All sections as places: the first source wins a name and spot; names that are refused go."""
    features, every = raw(spark, sf), None
    for i, (name, kind) in enumerate(SOURCES):
        s = sections.SECTIONS[name]
        rows = features.where(sections.at("y").isNotNull() & sections.at("x").isNotNull() & s.keep()).select("seq", *[c.alias(n) for n, c in s.columns().items()])
        rows = (s.after(rows) if name == "state_extra" else rows).select("seq", "n", "lat", "lng", F.lit(i).alias("source"), F.lit(kind).alias("type"))
        every = rows if every is None else every.unionByName(rows)
    k = every.where(rules.refusal(F.col("n")).isNull()).select("type", "source", "seq", F.lower(F.trim("n")).alias("nm"), F.floor(F.col("lat") * 300 + 0.5).alias("i"), F.floor(F.col("lng") * 300 + 0.5).alias("j"))
    return first_by(k, ["nm", "i", "j"], ["source", "seq"]).select("type", "nm", "i", "j", "source")
