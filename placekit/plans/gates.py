"""Gates, cascades, source union and first duplicates."""

from pyspark.sql import functions as F

from placekit.functions import names
from placekit.operators.resolve import candidate_pairs, suppress_near
from placekit.operators.spatial import first_by
from placekit.plans.adapter import prelude, view
from placekit.plans.registry import query

# Patterns that name kinds of places; the same text in both engines.
MEMBERS = r"(?i)\b(members only|private club|yacht club|beach club|golf club|country club)\b"
COMPANY = r"(?i)\b(llc|corp|company|realty|holdings)\b"
JUNK = r"^\W+$|<[a-z]"
COVERED = r"(?i)\bstate (park|forest)\b"
TRIBAL = r"(?i)\b(tribal|reservation|burial ground)\b"
GENERIC = r"(?i)^(unnamed|unknown|none|park|open space)$"
PARCEL = r"(?i)(^\d+ \w+ (street|st|road|rd|lane|ave)\b|\bparcel\b|\bsubdivision\b|\blot \d+)"
ALLOWED = ["Stone Bridge Golf Club"]


@query("gate_members_only", prelude("P") + f"SELECT key, name, name IN ('{ALLOWED[0]}') OR NOT regexp_matches(name, '{MEMBERS}') AS kept FROM P")
def gate_members_only(spark, sf):
    p = view(spark, sf, "P")
    return p.select("key", "name", (F.col("name").isin(*ALLOWED) | ~F.col("name").rlike(MEMBERS)).alias("kept"))


def reject_reason():
    n = F.col("name")
    return (
        F.when(n.isNull() | (F.length(F.trim(n)) < 3) & ~n.rlike(JUNK), "short").when(n.rlike(JUNK), "junk").when(n.isin(*ALLOWED), "kept")
        .when(n.rlike(MEMBERS), "members").when(n.rlike(COMPANY), "company").when((F.col("state") == "CT") & n.rlike(COVERED), "covered").otherwise("kept")
    )


_REASON = f"CASE WHEN name IS NULL OR (length(trim(name)) < 3 AND NOT regexp_matches(name, '{JUNK}')) THEN 'short' WHEN regexp_matches(name, '{JUNK}') THEN 'junk' WHEN name IN ('{ALLOWED[0]}') THEN 'kept' WHEN regexp_matches(name, '{MEMBERS}') THEN 'members' WHEN regexp_matches(name, '{COMPANY}') THEN 'company' WHEN state = 'CT' AND regexp_matches(name, '{COVERED}') THEN 'covered' ELSE 'kept' END"


@query("gate_reject_reason", prelude("P") + f"SELECT {_REASON} AS reason, count(*) AS n FROM P GROUP BY 1")
def gate_reject_reason(spark, sf):
    return view(spark, sf, "P").groupBy(reject_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("gate_duplicate_layer_scoped", prelude("P") + f"SELECT state, count(*) FILTER (WHERE {_REASON} = 'covered') AS n_dropped, count(*) FILTER (WHERE {_REASON} <> 'covered') AS n_kept FROM P GROUP BY state")
def gate_duplicate_layer_scoped(spark, sf):
    p = view(spark, sf, "P").withColumn("r", reject_reason())
    return p.groupBy("state").agg(F.count_if(F.col("r") == "covered").alias("n_dropped"), F.count_if(F.col("r") != "covered").alias("n_kept"))


@query("reject_generic_tribal_parcel", prelude("P") + f"SELECT key, regexp_matches(name, '{GENERIC}') AS generic, regexp_matches(name, '{TRIBAL}') AS tribal, regexp_matches(name, '{PARCEL}') AS parcel FROM P")
def reject_generic_tribal_parcel(spark, sf):
    n = F.col("name")
    return view(spark, sf, "P").select("key", n.rlike(GENERIC).alias("generic"), n.rlike(TRIBAL).alias("tribal"), n.rlike(PARCEL).alias("parcel"))


# Operator kinds, tested in this order.
KINDS = [("skip", r"(?i)\b(state of|water authority)\b"), ("federal", r"(?i)^us |\bfederal\b"), ("town", r"(?i)^(town|city) of\b"), ("university", r"(?i)\b(university|college)\b"), ("trust", r"(?i)\b(trust|conservancy)\b")]


@query("operator_cascade", prelude("P") + "SELECT key, CASE WHEN op IS NULL THEN 'none' " + " ".join(f"WHEN regexp_matches(op, '{r}') THEN '{k}'" for k, r in KINDS) + " ELSE 'other' END AS kind, regexp_replace(coalesce(op, ''), ',? Inc\\.?$', '') AS label, CASE WHEN regexp_matches(name, '" + GENERIC + "') THEN concat(regexp_replace(coalesce(op, 'Unknown'), ',? Inc\\.?$', ''), ' land') ELSE name END AS place FROM P")
def operator_cascade(spark, sf):
    op = F.col("op")
    kind = F.when(op.isNull(), "none")
    for k, r in KINDS:
        kind = kind.when(op.rlike(r), k)
    plain = lambda c: F.regexp_replace(c, r",? Inc\.?$", "")
    place = F.when(F.col("name").rlike(GENERIC), F.concat(plain(F.coalesce(op, F.lit("Unknown"))), F.lit(" land"))).otherwise(F.col("name"))
    return view(spark, sf, "P").select("key", kind.otherwise("other").alias("kind"), plain(F.coalesce(op, F.lit(""))).alias("label"), place.alias("place"))


@query("easement_filter", prelude("R") + "SELECT own, des, count(*) AS n FROM R WHERE own <> 'PVT' AND NOT (des = 'EASE' AND own NOT IN ('FED', 'STAT', 'LOC')) GROUP BY own, des")
def easement_filter(spark, sf):
    public = F.col("own").isin("FED", "STAT", "LOC")
    r = view(spark, sf, "R").where((F.col("own") != "PVT") & ~((F.col("des") == "EASE") & ~public))
    return r.groupBy("own", "des").agg(F.count(F.lit(1)).alias("n"))


_CELL = "CAST(floor(lat * 300 + 0.5) AS BIGINT) AS ci, CAST(floor(lng * 300 + 0.5) AS BIGINT) AS cj"


@query("union_precedence", prelude("P", "C", "R") + f", U AS (SELECT key, 'place' AS src, 1 AS rank, name, {_CELL} FROM P UNION ALL SELECT key, 'site', 2, name, {_CELL} FROM C UNION ALL SELECT key, 'rated', 3, name, {_CELL} FROM R) SELECT key, src FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), ci, cj ORDER BY rank, key) AS n FROM U) WHERE n = 1")
def union_precedence(spark, sf):
    parts = [view(spark, sf, r).select("key", F.lit(s).alias("src"), F.lit(i).alias("rank"), "name", *[F.floor(F.col(c) * 300 + 0.5).alias(k) for c, k in (("lat", "ci"), ("lng", "cj"))]) for i, (r, s) in enumerate((("P", "place"), ("C", "site"), ("R", "rated")), 1)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("low", F.lower("name"))
    return first_by(u, ["low", "ci", "cj"], ["rank", "key"]).select("key", "src")


@query("distinct_name_cell", prelude("P") + "SELECT s AS scale, count(DISTINCT concat(lower(name), '|', CAST(floor(lat * s + 0.5) AS BIGINT), '|', CAST(floor(lng * s + 0.5) AS BIGINT))) AS n_distinct FROM P, (VALUES (200), (300), (500), (2000)) t(s) GROUP BY s")
def distinct_name_cell(spark, sf):
    p = view(spark, sf, "P").withColumn("scale", F.explode(F.array(*[F.lit(s) for s in (200, 300, 500, 2000)])))
    cells = [F.floor(F.col(c) * F.col("scale") + 0.5).alias(k) for c, k in (("lat", "i"), ("lng", "j"))]
    return p.select("scale", F.lower("name").alias("low"), *cells).distinct().groupBy("scale").agg(F.count(F.lit(1)).alias("n_distinct"))


@query("argmax_property", prelude("L") + "SELECT part AS property, arg_min(key, (-v, key, px)) AS best_key, max(v) AS acres FROM L WHERE v >= 5 GROUP BY part")
def argmax_property(spark, sf):
    best = F.min_by("key", F.struct((-F.col("v")).alias("v"), "key", "px"))
    return view(spark, sf, "L").where("v >= 5").groupBy(F.col("part").alias("property")).agg(best.alias("best_key"), F.max("v").alias("acres"))


_WORDS = ["trails", "parking", "sports", "playground", "beach", "pool"]


@query("flag_labels", prelude("P") + "SELECT key, concat_ws(',', " + ", ".join(f"CASE WHEN {w} THEN '{w}' END" for w in _WORDS) + ") AS labels FROM P")
def flag_labels(spark, sf):
    return view(spark, sf, "P").select("key", F.concat_ws(",", *[F.when(F.col(w), w) for w in _WORDS]).alias("labels"))


_RICH = "(" + " + ".join(f"CAST({w} AS INT)" for w in _WORDS) + ") * 1000000 + coalesce(acres, 0) * 4 + CASE WHEN url IS NOT NULL THEN 2 ELSE 0 END"
_NORM = "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"


def richness():
    n = F.lit(0)
    for w in _WORDS:
        n = n + F.col(w).cast("int")
    return (n * 1000000 + F.coalesce("acres", F.lit(0)) * 4 + F.when(F.col("url").isNotNull(), 2).otherwise(0)).cast("long")


@query("dedupe_name_town", prelude("P") + f"SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY {_NORM}, town ORDER BY {_RICH} DESC, key) AS n FROM P) WHERE n = 1")
def dedupe_name_town(spark, sf):
    p = view(spark, sf, "P").withColumn("nm", names.norm(F.col("name"))).withColumn("rich", richness())
    # the richest of each name and town, by a map-side maximum
    return p.groupBy("nm", "town").agg(F.min_by("key", F.struct((-F.col("rich")).alias("r"), "key")).alias("key")).select("key")


@query("dedupe_nms_800m")
def dedupe_nms_800m(spark, sf):
    return suppress_near(view(spark, sf, "P").withColumn("rich", richness()).select("key", "name", "lat", "lng", "rich"))


_FILL = ", ".join(f"'{w}'" for w in names.FILLER)


def _tok(c: str) -> str:
    words = f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"
    own = f"list_filter({words}, lambda w: length(w) > 1 AND w NOT IN ({_FILL}))"
    return f"CASE WHEN len({own}) = 0 THEN list_sort({words}) ELSE list_sort({own}) END"


_REL = "len(list_intersect(t1, t2)) > 0 AND (len(list_intersect(t1, t2)) = least(len(t1), len(t2)) OR (len(list_intersect(t1, t2)) >= 2 AND len(list_intersect(t1, t2)) * 10 >= (len(t1) + len(t2) - len(list_intersect(t1, t2))) * 6))"
_MEAN = "sqrt(power((b.lat - a.lat) * 111320, 2) + power((b.lng - a.lng) * 111320 * cos(radians((a.lat + b.lat) / 2)), 2))"


@query("candidate_pairs", prelude("P") + f", T AS (SELECT key, lat, lng, type, coalesce(acres, 0) AS acres, {_tok('name')} AS t FROM P), X AS (SELECT a.key AS k1, b.key AS k2, a.t AS t1, b.t AS t2, {_MEAN} AS d, greatest(a.acres, b.acres) AS ac FROM T a JOIN T b ON a.key < b.key AND abs(a.lat - b.lat) < 0.021 WHERE NOT ((a.type = 'cemetery' OR b.type = 'cemetery') AND a.type <> b.type)) SELECT k1, k2, CAST(floor(d) AS BIGINT) AS dist_m FROM X WHERE {_REL} AND d <= CASE WHEN len(list_intersect(t1, t2)) = least(len(t1), len(t2)) THEN greatest(1200, 400 + least(1800, sqrt(ac * 4047 / pi()))) ELSE 400 + least(1800, sqrt(ac * 4047 / pi())) END")
def candidates(spark, sf):
    return candidate_pairs(view(spark, sf, "P"))


@query("name_related", prelude("P") + f", T AS (SELECT DISTINCT name, {_tok('name')} AS t FROM P), X AS (SELECT a.name AS n1, b.name AS n2, a.t AS t1, b.t AS t2 FROM T a JOIN T b ON a.name < b.name) SELECT n1, n2 FROM X WHERE {_REL}")
def name_related(spark, sf):
    t = view(spark, sf, "P").select("name").distinct().withColumn("t", names.tokens(F.col("name")))
    a = t.select(F.col("name").alias("n1"), F.col("t").alias("t1"), F.explode("t").alias("w"))
    b = t.select(F.col("name").alias("n2"), F.col("t").alias("t2"), F.explode("t").alias("w2"))
    met = a.join(b, (F.col("w") == F.col("w2")) & (F.col("n1") < F.col("n2")))
    return met.where(names.related(F.col("t1"), F.col("t2"))).select("n1", "n2").distinct()


@query("better_name", prelude("P") + f", X AS (SELECT a.key AS k1, a.key + 1 AS k2, a.name AS n1, b.name AS n2, a.acres AS a1, b.acres AS a2 FROM P a JOIN P b ON b.key = a.key + 1) SELECT k1, k2, CASE WHEN regexp_matches(n1, '(?i)(north|south|field)$') <> regexp_matches(n2, '(?i)(north|south|field)$') THEN CASE WHEN regexp_matches(n2, '(?i)(north|south|field)$') THEN n1 ELSE n2 END WHEN regexp_matches(n1, '{PARCEL}') <> regexp_matches(n2, '{PARCEL}') THEN CASE WHEN regexp_matches(n2, '{PARCEL}') THEN n1 ELSE n2 END WHEN abs(a1 - a2) > 1 THEN CASE WHEN a1 > a2 THEN n1 ELSE n2 END WHEN length(n2) > length(n1) THEN n2 ELSE n1 END AS winner FROM X")
def better_name(spark, sf):
    p = view(spark, sf, "P").select("key", "name", "acres")
    x = p.select(F.col("key").alias("k1"), (F.col("key") + 1).alias("k2"), F.col("name").alias("n1"), F.col("acres").alias("a1")).join(p.select(F.col("key").alias("k2"), F.col("name").alias("n2"), F.col("acres").alias("a2")), "k2")
    n1, n2 = F.col("n1"), F.col("n2")
    sub, lot = (lambda c: c.rlike("(?i)(north|south|field)$")), (lambda c: c.rlike(PARCEL))
    win = F.when(sub(n1) != sub(n2), F.when(sub(n2), n1).otherwise(n2)).when(lot(n1) != lot(n2), F.when(lot(n2), n1).otherwise(n2))
    win = win.when(F.abs(F.col("a1") - F.col("a2")) > 1, F.when(F.col("a1") > F.col("a2"), n1).otherwise(n2)).when(F.length(n2) > F.length(n1), n2).otherwise(n1)
    return x.select("k1", "k2", win.alias("winner"))


@query("place_id", prelude("P") + f"SELECT key, substr(sha256(concat(array_to_string({_tok('name')}, ' '), '|', CAST(floor(lat * 100 + 0.5) AS BIGINT), '|', CAST(floor(lng * 100 + 0.5) AS BIGINT))), 1, 10) AS id FROM P")
def place_id(spark, sf):
    cells = [F.floor(F.col(c) * 100 + 0.5).cast("string") for c in ("lat", "lng")]
    return view(spark, sf, "P").select("key", F.substring(F.sha2(F.concat_ws("|", names.core_key(F.col("name")), *cells), 256), 1, 10).alias("id"))


@query("norm_names", prelude("P") + f"SELECT key, {_NORM} AS nm, array_to_string({_tok('name')}, ' ') AS core FROM P")
def norm_names(spark, sf):
    return view(spark, sf, "P").select("key", names.norm(F.col("name")).alias("nm"), names.core_key(F.col("name")).alias("core"))


@query("pretty_name", prelude("P") + r", X AS (SELECT key, trim(regexp_replace(CASE WHEN regexp_matches(name, '^Town of [A-Za-z ]+ \((.+)\)$') THEN regexp_extract(name, '^Town of [A-Za-z ]+ \((.+)\)$', 1) ELSE name END, '[_ ]+', ' ', 'g')) AS n FROM P) SELECT key, CASE WHEN regexp_matches(n, '[a-z]') OR NOT regexp_matches(n, '[A-Z]') THEN n ELSE array_to_string([concat(upper(w[1]), lower(w[2:])) for w in string_split(n, ' ')], ' ') END AS pretty FROM X")
def pretty_name(spark, sf):
    return view(spark, sf, "P").select("key", names.pretty(F.col("name")).alias("pretty"))
