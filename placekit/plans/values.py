"""Verdicts, scores, formatted values and raster summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from placekit.functions import geo, verdicts
from placekit.plans.adapter import FLAGS, prelude, view
from placekit.plans.registry import query

_VIS = "(trails OR parking OR sports OR playground OR beach OR pool)"
_FIRST = "CASE WHEN private THEN 'closed' WHEN official = 'Closed' THEN 'closed' WHEN official = 'Open' THEN 'open' WHEN official = 'Restricted' THEN 'permission' WHEN type IN ('state', 'national', 'town') THEN 'open' WHEN type IN ('preserve', 'cemetery') THEN 'permission' ELSE 'unknown' END"
_FREE = r"regexp_matches(lower(coalesce(fee, '')), '\bfree\b')"
_CHARGE = r"(regexp_matches(lower(coalesce(fee, '')), '\$\d|\badmission\b|\bfee\b') AND NOT regexp_matches(lower(coalesce(fee, '')), '\bno fee\b'))"
_PARK = _CHARGE + r" AND regexp_matches(lower(coalesce(fee, '')), '\bparking\b|\bvehicle\b')"
JUDGED = f"A AS (SELECT *, CASE WHEN NOT {_VIS} AND NOT reachable AND {_FIRST} <> 'closed' AND official IS NULL THEN 'unknown' ELSE {_FIRST} END AS access, CASE WHEN {_CHARGE} AND NOT {_FREE} AND NOT ({_PARK}) THEN 'paid' WHEN {_PARK} THEN 'parking' WHEN {_FREE} THEN 'free' WHEN type = 'state' THEN 'parking' ELSE 'free' END AS fee_state FROM P), B AS (SELECT *, CASE WHEN fee_state = 'paid' THEN 'fee' WHEN access IN ('open', 'permission') AND NOT private AND ({_VIS} OR reachable) AND shaped THEN 'park' ELSE 'unverified' END AS status FROM A)"


def judged(spark, sf):
    p = view(spark, sf, "P").withColumn("access", verdicts.access()).withColumn("fee_state", verdicts.fee_state())
    return p.withColumn("status", verdicts.status())


def _j(select: str) -> str:
    return prelude("P") + f", {JUDGED} {select}"


@query("classify_access", _j("SELECT key, access FROM B"))
def classify_access(spark, sf):
    return judged(spark, sf).select("key", "access")


@query("fee_state", _j("SELECT key, fee_state FROM B"))
def fee_state(spark, sf):
    return judged(spark, sf).select("key", "fee_state")


_WHY = f"concat_ws('; ', CASE WHEN NOT (access IN ('open', 'permission') AND NOT private) THEN 'no right of access' END, CASE WHEN NOT ({_VIS} OR reachable) THEN 'no way in known' END, CASE WHEN NOT shaped THEN 'no boundary' END)"


@query("verify_status", _j(f"SELECT key, status, {_WHY} AS why FROM B"))
def verify_status(spark, sf):
    return judged(spark, sf).select("key", "status", verdicts.reasons().alias("why"))


@query("status_reason", _j(f"SELECT key, {_WHY} AS reason FROM B WHERE status = 'unverified'"))
def status_reason(spark, sf):
    return judged(spark, sf).where("status = 'unverified'").select("key", verdicts.reasons().alias("reason"))


_TIER = "CASE WHEN status IN ('park', 'fee') THEN 'open' WHEN access IN ('open', 'permission') THEN 'probably' ELSE 'unknown' END"


@query("status_tier", _j(f"SELECT lower(name) AS name, arg_min({_TIER}, key) AS tier FROM B GROUP BY 1"))
def status_tier(spark, sf):
    return judged(spark, sf).groupBy(F.lower("name").alias("name")).agg(F.min_by(verdicts.tier(), "key").alias("tier"))


@query("status_tallies", _j("SELECT status, fee_state, count(*) AS n FROM B GROUP BY 1, 2"))
def status_tallies(spark, sf):
    return judged(spark, sf).groupBy("status", "fee_state").agg(F.count(F.lit(1)).alias("n"))


_EV = " + ".join(f"CAST({f} AS BIGINT)" for f in FLAGS if f != "researched")


@query("evidence_score", prelude("P") + f"SELECT key, {_EV} + CASE WHEN researched THEN 20 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(acres, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN fee IS NOT NULL THEN 1 ELSE 0 END AS score FROM P")
def evidence_score(spark, sf):
    return view(spark, sf, "P").select("key", verdicts.evidence([f for f in FLAGS if f != "researched"]).cast("long").alias("score"))


@query("steward_precedence", prelude("P") + "SELECT key, coalesce(op, CASE type WHEN 'state' THEN 'the state' WHEN 'national' THEN 'the nation' WHEN 'town' THEN 'the town' ELSE 'an owner not known' END) AS steward FROM P")
def steward_precedence(spark, sf):
    t = F.col("type")
    return view(spark, sf, "P").select("key", F.coalesce("op", F.when(t == "state", "the state").when(t == "national", "the nation").when(t == "town", "the town").otherwise("an owner not known")).alias("steward"))


@query("historic_beach_flags", prelude("P") + "SELECT key, regexp_matches(name, '(?i)historic|burying') AS historic, beach OR regexp_matches(name, '(?i)beach') AS beach, beach OR regexp_matches(name, '(?i)beach|pond|lake|river|reservoir') AS water FROM P")
def historic_beach_flags(spark, sf):
    n = F.col("name")
    return view(spark, sf, "P").select("key", n.rlike("(?i)historic|burying").alias("historic"), (F.col("beach") | n.rlike("(?i)beach")).alias("beach"), (F.col("beach") | n.rlike("(?i)beach|pond|lake|river|reservoir")).alias("water"))


@query("note_sentences", prelude("P") + "SELECT key, concat_ws(' ', CASE WHEN parking THEN 'Cars can park.' END, CASE WHEN reachable THEN 'A road leads there.' END, CASE WHEN fee IS NOT NULL THEN concat('Fee: ', fee, '.') END) AS note FROM P")
def note_sentences(spark, sf):
    return view(spark, sf, "P").select("key", F.concat_ws(" ", F.when(F.col("parking"), "Cars can park."), F.when(F.col("reachable"), "A road leads there."), F.when(F.col("fee").isNotNull(), F.concat(F.lit("Fee: "), "fee", F.lit(".")))).alias("note"))


@query("landuse_override", prelude("P") + "SELECT key, CASE WHEN regexp_matches(name, '(?i)state (park|forest)') AND regexp_matches(coalesce(op, ''), '(?i)state') THEN 'state' ELSE type END AS type FROM P")
def landuse_override(spark, sf):
    state = F.col("name").rlike("(?i)state (park|forest)") & F.coalesce("op", F.lit("")).rlike("(?i)state")
    return view(spark, sf, "P").select("key", F.when(state, "state").otherwise(F.col("type")).alias("type"))


@query("by_permission_flag", prelude("R") + "SELECT key, own IN ('NGO', 'PVT') AND code IN ('RA', 'UK') AS by_permission FROM R")
def by_permission_flag(spark, sf):
    return view(spark, sf, "R").select("key", (F.col("own").isin("NGO", "PVT") & F.col("code").isin("RA", "UK")).alias("by_permission"))


@query("radius_and_acres", prelude("P") + "SELECT key, CAST(floor(CASE WHEN coalesce(acres, 0) <= 0 THEN 120 ELSE least(2200, greatest(90, sqrt(acres * 4047 / pi()))) END) AS BIGINT) AS radius_m, CAST(floor(coalesce(acres, 0) * 4046.86::DOUBLE) AS BIGINT) AS square_m FROM P")
def radius_and_acres(spark, sf):
    return view(spark, sf, "P").select("key", F.floor(geo.radius_m(F.col("acres"))).alias("radius_m"), F.floor(F.coalesce("acres", F.lit(0)) * 4046.86).alias("square_m"))


@query("formatters", prelude("L") + "SELECT key, px, CASE WHEN v < 12 THEN 'flat' WHEN v < 40 THEN 'rolling' ELSE 'hilly' END AS terrain, CASE WHEN v < 30 THEN concat(v, ' min') ELSE concat(v // 30, ' h ', v % 30, ' min') END AS took FROM L")
def formatters(spark, sf):
    v = F.col("v")
    took = F.when(v < 30, F.concat(v.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(v / 30).cast("string"), F.lit(" h "), (v % 30).cast("string"), F.lit(" min")))
    return view(spark, sf, "L").select("key", "px", F.when(v < 12, "flat").when(v < 40, "rolling").otherwise("hilly").alias("terrain"), took.alias("took"))


@query("elevation_stats", prelude("L") + "SELECT key, CAST(floor(avg(v) + 0.5) AS BIGINT) AS elev, CASE WHEN count(*) > 1 AND max(v) > min(v) THEN max(v) - min(v) END AS relief FROM L GROUP BY key")
def elevation_stats(spark, sf):
    spread = F.max("v") - F.min("v")
    return view(spark, sf, "L").groupBy("key").agg(F.floor(F.avg("v") + 0.5).alias("elev"), F.when(spread > 0, spread).alias("relief"))


@query("landcover_mix", prelude("L") + "SELECT key, CAST(floor(100.0 * count(*) FILTER (WHERE cls IN ('grass', 'crops')) / greatest(1, count(*) FILTER (WHERE cls <> 'water')) + 0.5) AS BIGINT) AS open_pct, CASE WHEN count(*) FILTER (WHERE cls IN ('grass', 'crops')) * 100 >= 65 * count(*) FILTER (WHERE cls <> 'water') THEN 'open' WHEN count(*) FILTER (WHERE cls IN ('grass', 'crops')) * 100 >= 30 * count(*) FILTER (WHERE cls <> 'water') THEN 'mixed' ELSE 'wooded' END AS cover, count(*) FILTER (WHERE cls = 'water') * 100 >= 12 * count(*) AS water FROM L GROUP BY key")
def landcover_mix(spark, sf):
    c = F.col("cls")
    s = view(spark, sf, "L").groupBy("key").agg(F.count_if(c.isin("grass", "crops")).alias("o"), F.count_if(c != "water").alias("land"), F.count_if(c == "water").alias("wet"), F.count(F.lit(1)).alias("n"))
    cover = F.when(F.col("o") * 100 >= 65 * F.col("land"), "open").when(F.col("o") * 100 >= 30 * F.col("land"), "mixed").otherwise("wooded")
    return s.select("key", F.floor(100.0 * F.col("o") / F.greatest(F.lit(1), "land") + 0.5).alias("open_pct"), cover.alias("cover"), (F.col("wet") * 100 >= 12 * F.col("n")).alias("water"))


@query("landcover_top", prelude("L") + "SELECT key, arg_max(cls, (n, -first, cls)) AS top FROM (SELECT key, cls, count(*) AS n, min(px) AS first FROM L GROUP BY key, cls) GROUP BY key")
def landcover_top(spark, sf):
    n = view(spark, sf, "L").groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("first"))
    return n.groupBy("key").agg(F.max_by("cls", F.struct("n", (-F.col("first")).alias("f"), "cls")).alias("top"))


# A palette of classes.
PALETTE = [("water", 70, 107, 159), ("grass", 223, 223, 194), ("forest", 104, 171, 95), ("crops", 220, 217, 57), ("barren", 179, 172, 159)]
_RGB = "(v * 5) AS r, (v * 3 + px * 10) AS g, (200 - v * 3) AS b"


@query("palette_nearest", prelude("L") + f", X AS (SELECT key, px, {_RGB} FROM L), D AS (SELECT key, px, c, power(r - pr, 2) + power(g - pg, 2) + power(b - pb, 2) AS d FROM X, (VALUES " + ", ".join(map(str, PALETTE)) + ") p(c, pr, pg, pb)) SELECT key, px, arg_min(c, (d, c)) AS class FROM D GROUP BY key, px HAVING min(d) < 6348")
def palette_nearest(spark, sf):
    """The palette is a constant of five rows: distances are one expression each."""
    x = view(spark, sf, "L").selectExpr("key", "px", *_RGB.replace(") AS", ") as").split(", "))
    far = F.array(*[F.struct(((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)).alias("d"), F.lit(c).alias("c")) for c, r, g, b in PALETTE])
    x = x.withColumn("near", F.array_min(far)).where("near.d < 6348")
    return x.groupBy("key", "px").agg(F.min("near").alias("near")).select("key", "px", F.col("near.c").alias("class"))


@query("enrich_carry_forward", prelude("P") + "SELECT p.key, CASE WHEN q.key IS NULL OR q.key % 4 = 0 THEN NULL ELSE q.key % 300 END AS elev, q.key IS NULL OR q.key % 4 = 0 OR q.key % 5 = 0 AS requeue FROM P p LEFT JOIN (SELECT key FROM P WHERE key % 3 <> 0) q ON p.key = q.key")
def enrich_carry_forward(spark, sf):
    p = view(spark, sf, "P").select("key")
    old = p.where("key % 3 <> 0").select("key", F.when(F.col("key") % 4 != 0, F.col("key") % 300).alias("elev"), F.when(F.col("key") % 5 != 0, "grass").alias("top"))
    return p.join(old, "key", "left").select("key", "elev", (F.col("elev").isNull() | F.col("top").isNull()).alias("requeue"))


@query("consensus_rules", prelude("L") + ", X AS (SELECT part, count(*) FILTER (WHERE flag = 'A') AS y, count(*) FILTER (WHERE flag = 'R') AS n FROM L GROUP BY part) SELECT part, CASE WHEN y + n = 0 THEN NULL WHEN n = 0 THEN 'all' WHEN y = 0 THEN 'none' WHEN y >= 3 * n THEN 'most' ELSE 'some' END AS verdict FROM X")
def consensus_rules(spark, sf):
    x = view(spark, sf, "L").groupBy("part").agg(F.count_if(F.col("flag") == "A").alias("y"), F.count_if(F.col("flag") == "R").alias("n"))
    y, n = F.col("y"), F.col("n")
    return x.select("part", F.when(y + n == 0, F.lit(None)).when(n == 0, "all").when(y == 0, "none").when(y >= 3 * n, "most").otherwise("some").alias("verdict"))


@query("run_gaps_islands", prelude("L") + ", X AS (SELECT key, px, v, cls <> 'water' AS ok, px - row_number() OVER (PARTITION BY key, cls <> 'water' ORDER BY px) AS g FROM (SELECT key, px, any_value(v) AS v, any_value(cls) AS cls FROM (SELECT DISTINCT ON (key, px) * FROM L ORDER BY key, px, v, part) GROUP BY key, px)) SELECT key, min(px) AS first, count(*) AS cells, CAST(sum(v) AS BIGINT) AS len FROM X WHERE ok GROUP BY key, g")
def run_gaps_islands(spark, sf):
    x = _cells(spark, sf).where("cls <> 'water'")
    x = x.withColumn("g", F.col("px") - F.row_number().over(Window.partitionBy("key").orderBy("px")))
    return x.groupBy("key", "g").agg(F.min("px").alias("first"), F.count(F.lit(1)).alias("cells"), F.sum("v").alias("len")).drop("g")


def _cells(spark, sf):
    """One value for each cell of a path: the least."""
    return view(spark, sf, "L").groupBy("key", "px").agg(F.min(F.struct("v", "part", "cls")).alias("m")).select("key", "px", F.col("m.v").alias("v"), F.col("m.cls").alias("cls"))


_CELLS = "X AS (SELECT key, px, v FROM (SELECT *, row_number() OVER (PARTITION BY key, px ORDER BY v, part) AS n FROM L) WHERE n = 1)"


@query("dash_pieces", prelude("L") + f", {_CELLS}, Y AS (SELECT key, px, sum(v) OVER (PARTITION BY key ORDER BY px) AS s FROM X) SELECT key, px, CAST(s AS BIGINT) AS run, CAST(s AS BIGINT) % 40 < 24 AS drawn FROM Y")
def dash_pieces(spark, sf):
    run = F.sum("v").over(Window.partitionBy("key").orderBy("px").rowsBetween(Window.unboundedPreceding, 0))
    return _cells(spark, sf).select("key", "px", run.alias("run"), (run % 40 < 24).alias("drawn"))


@query("neighbour_drop", prelude("L") + f", {_CELLS}, Y AS (SELECT key, px, v, least(lag(v) OVER w, lead(v) OVER w) AS low, lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL AS edge FROM X WINDOW w AS (PARTITION BY key ORDER BY px)) SELECT key, px, greatest(0, v - coalesce(low, v)) AS fall, edge FROM Y")
def neighbour_drop(spark, sf):
    w = Window.partitionBy("key").orderBy("px")
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return _cells(spark, sf).select("key", "px", F.greatest(F.lit(0), F.col("v") - F.coalesce(F.least(before, after), F.col("v"))).alias("fall"), (before.isNull() | after.isNull()).alias("edge"))


@query("tree_mask_percentile", prelude("L") + ", X AS (SELECT part, v, key, px, row_number() OVER (PARTITION BY part ORDER BY v, key, px) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM L), C AS (SELECT part, any_value(n) AS n, max(CASE WHEN i = CAST(floor(n * 0.65) AS BIGINT) THEN v END) AS cut FROM X GROUP BY part) SELECT part, cut, n FROM C WHERE n >= 20")
def tree_mask_percentile(spark, sf):
    w = Window.partitionBy("part")
    x = view(spark, sf, "L").withColumn("i", F.row_number().over(w.orderBy("v", "key", "px")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return x.groupBy("part").agg(F.max(F.when(F.col("i") == F.floor(F.col("n") * 0.65), F.col("v"))).alias("cut"), F.max("n").alias("n")).where("n >= 20").select("part", "cut", "n")


@query("height_box_mean", prelude("L") + "SELECT part, CAST(floor(px / 2) AS BIGINT) AS cell, CAST(floor(avg(v * 256 + px) + 0.5) AS BIGINT) AS h FROM L GROUP BY 1, 2")
def height_box_mean(spark, sf):
    return view(spark, sf, "L").groupBy("part", F.floor(F.col("px") / 2).alias("cell")).agg(F.floor(F.avg(F.col("v") * 256 + F.col("px")) + 0.5).alias("h"))


@query("ndvi_mean", prelude("L") + "SELECT part, CAST(floor(1000 * avg((v - px) / CAST(v + px AS DOUBLE)) + 0.5) AS BIGINT) AS ndvi_e3 FROM L GROUP BY part")
def ndvi_mean(spark, sf):
    return view(spark, sf, "L").groupBy("part").agg(F.floor(1000 * F.avg((F.col("v") - F.col("px")) / (F.col("v") + F.col("px"))) + 0.5).alias("ndvi_e3"))


@query("lore_lists", prelude("L") + "SELECT part, array_to_string(list_slice(list_sort(list(DISTINCT cls)), 1, 3), ',') AS kinds, CAST(sum(v) AS BIGINT) AS total FROM L GROUP BY part")
def lore_lists(spark, sf):
    return view(spark, sf, "L").groupBy("part").agg(F.array_join(F.slice(F.array_sort(F.collect_set("cls")), 1, 3), ",").alias("kinds"), F.sum("v").alias("total"))


@query("events_windowed", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, sf):
    from placekit.streaming.events import windowed_counts

    return windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
