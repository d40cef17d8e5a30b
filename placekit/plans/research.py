"""Research overlay: rules, entries, audit, publishing."""

from pyspark.sql import functions as F

from placekit.functions import geo, names
from placekit.operators.spatial import first_by, radius_join
from placekit.plans.adapter import prelude, view
from placekit.plans.registry import query

# rule, number, scope, type to match (null: any), fact, value
RULES = [
    ("r-state", 1, "CT", "state", "reachable", "yes"), ("r-town", 2, "CT", "town", "reachable", "no"), ("r-any", 3, "CT", None, "checked", "2024"),
    ("r-town-late", 4, "CT", "town", "reachable", "yes"), ("r-ny", 5, "NY", "state", "checked", "2025"), ("r-dead", 6, "CT", "airport", "checked", "2023"), ("r-dormant", 7, "VT", "state", "checked", "2022"),
]
_RULES = "V AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in RULES) + ") v(rule, no, scope, kind, fact, value))"
_HIT = "P.state = V.scope AND (V.kind IS NULL OR V.kind = P.type)"


def rules(spark):
    """A table of rules: a handful, kept by hand, so it is broadcast."""
    return spark.createDataFrame(RULES, "rule string, no int, scope string, kind string, fact string, value string")


def hits(spark, sf):
    match = (F.col("state") == F.col("scope")) & (F.col("kind").isNull() | (F.col("kind") == F.col("type")))
    return view(spark, sf, "P").select("key", "state", "type").join(F.broadcast(rules(spark)), match)


@query("rule_apply_last_wins", prelude("P") + f", {_RULES} SELECT key, fact, arg_max(value, no) AS value FROM P JOIN V ON {_HIT} GROUP BY key, fact")
def rule_apply_last_wins(spark, sf):
    return hits(spark, sf).groupBy("key", "fact").agg(F.max_by("value", "no").alias("value"))


@query("rule_dead_dormant", prelude("P") + f", {_RULES}, H AS (SELECT rule, count(*) AS n FROM P JOIN V ON {_HIT} GROUP BY rule) SELECT V.rule, coalesce(n, 0) AS hits, CASE WHEN n > 0 THEN 'live' WHEN scope IN (SELECT state FROM P) THEN 'dead' ELSE 'dormant' END AS verdict FROM V LEFT JOIN H ON V.rule = H.rule")
def rule_dead_dormant(spark, sf):
    n = hits(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    seen = view(spark, sf, "P").select(F.col("state").alias("scope")).distinct().withColumn("there", F.lit(True))
    out = rules(spark).join(n, "rule", "left").join(seen, "scope", "left")
    return out.select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("hits"), F.when(F.col("n") > 0, "live").when(F.col("there"), "dead").otherwise("dormant").alias("verdict"))


# entry, id, name, town, lat, lng
ENTRIES = [("e1", 7, None, None, None, None), ("e2", None, "Oak Hill", 3, None, None), ("e3", None, "CEDAR beach", None, None, None), ("e4", None, "Nowhere At All", None, 41.25, -73.25), ("e5", None, "Nowhere Else", None, 10.0, 10.0)]
_ENTRIES = "N AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in e) + ")" for e in ENTRIES) + ") n(entry, id, name, town, lat, lng))"
_NM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_CHAIN = f"{_ENTRIES}, Q AS (SELECT *, {_NM.format('name')} AS nm FROM P), M AS (SELECT n.entry, 1 AS step, 'id' AS how, p.key FROM N n JOIN Q p ON p.key = n.id UNION ALL SELECT n.entry, 2, 'name+town', min(p.key) FROM N n JOIN Q p ON p.nm = {_NM.format('n.name')} AND p.town = n.town GROUP BY 1 UNION ALL SELECT n.entry, 3, 'name', min(p.key) FROM N n JOIN Q p ON p.nm = {_NM.format('n.name')} GROUP BY 1 UNION ALL SELECT entry, 4, 'near', arg_min(key, (floor(d * 1000), key)) FROM (SELECT n.entry, p.key, sqrt(power((p.lat - n.lat) * 111000, 2) + power((p.lng - n.lng) * 111000 * cos(radians(n.lat)), 2)) AS d FROM N n JOIN Q p ON n.lat IS NOT NULL) WHERE d < 6000 GROUP BY 1), E AS (SELECT N.entry, arg_min(M.key, step) AS key, coalesce(arg_min(how, step), 'none') AS how FROM N LEFT JOIN M ON N.entry = M.entry GROUP BY N.entry)"


def matched(spark, sf, anchor: float = 6000.0):
    """Each entry with the place that the first of its keys finds: id, name and town, name, nearest."""
    n = spark.createDataFrame(ENTRIES, "entry string, id long, name string, town long, lat double, lng double").withColumn("nm", names.norm(F.col("name")))
    p = view(spark, sf, "P").select("key", "town", "lat", "lng", names.norm(F.col("name")).alias("p_nm"))
    small = F.broadcast(n)
    by_id = p.join(small.select("entry", "id"), F.col("key") == F.col("id")).select("entry", F.lit(1).alias("step"), F.lit("id").alias("how"), "key")
    by_name = p.join(small.select("entry", "nm", F.col("town").alias("t")), F.col("p_nm") == F.col("nm"))
    both = by_name.where("town = t").select("entry", F.lit(2).alias("step"), F.lit("name+town").alias("how"), "key")
    name = by_name.select("entry", F.lit(3).alias("step"), F.lit("name").alias("how"), "key")
    near = radius_join(n.where("lat IS NOT NULL").select("entry", "lat", "lng"), p.select(F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("key")), F.lit(anchor), 0.06)
    near = near.where(F.col("dist") < anchor).groupBy("entry").agg(F.min_by("key", F.struct(F.floor(F.col("dist") * 1000), F.col("key"))).alias("key")).select("entry", F.lit(4).alias("step"), F.lit("near").alias("how"), "key")
    first = both.unionByName(name).unionByName(by_id).unionByName(near).groupBy("entry").agg(F.min(F.struct("step", "key", "how")).alias("m"))
    return n.select("entry").join(first, "entry", "left").select("entry", F.col("m.key").alias("key"), F.coalesce("m.how", F.lit("none")).alias("how"))


@query("entry_match_chain", prelude("P") + f", {_CHAIN} SELECT entry, key, how FROM E")
def entry_match_chain(spark, sf):
    return matched(spark, sf)


@query("audit_summary", prelude("P") + f", {_RULES}, {_CHAIN} SELECT (SELECT count(*) FROM E) AS entries, (SELECT count(*) FROM E WHERE how <> 'none') AS matched, (SELECT count(*) FROM V WHERE scope IN (SELECT state FROM P) AND rule NOT IN (SELECT rule FROM P JOIN V ON {_HIT})) AS dead, (SELECT count(*) FROM P WHERE researched) AS researched")
def audit_summary(spark, sf):
    e = matched(spark, sf).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("how") != "none").alias("matched"))
    dead = rule_dead_dormant(spark, sf).agg(F.count_if(F.col("verdict") == "dead").alias("dead"))
    known = view(spark, sf, "P").agg(F.count_if(F.col("researched")).alias("researched"))
    return e.join(dead).join(known)  # three single rows


# Entries that the shorter chain has no key for: a name that a place wore, and anchors 400 m and 1 km from the place of key 20.
WHOLE = [*ENTRIES, ("e6", None, "the KNOB", None, None, None), ("e7", None, "No Name", 3, 41.2114, -73.4862), ("e8", None, "No Name", 3, 41.2168, -73.4862), ("e9", -1, "Old Beach", 5, 41.25, -73.25)]
AKA = [("oak hill", "The Knob"), ("cedar beach", "Old Beach")]
_WHOLE = "N AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in e) + ")" for e in WHOLE) + ") n(entry, id, name, town, lat, lng)), A AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}')" for n, a in AKA) + ") a(n, alias))"
_MEAN = "sqrt(power((p.lat - n.lat) * 111320, 2) + power((p.lng - n.lng) * 111320 * cos(radians((p.lat + n.lat) / 2)), 2))"
_STEPS = f"{_WHOLE}, Q AS (SELECT *, {_NM.format('name')} AS nm FROM P), M AS (SELECT n.entry, 1 AS step, 'id' AS how, p.key FROM N n JOIN Q p ON p.key = n.id UNION ALL SELECT n.entry, 2, 'name+town', min(p.key) FROM N n JOIN Q p ON p.nm = {_NM.format('n.name')} AND p.town = n.town GROUP BY 1 UNION ALL SELECT n.entry, 3, 'name', min(p.key) FROM N n JOIN Q p ON p.nm = {_NM.format('n.name')} GROUP BY 1 UNION ALL SELECT n.entry, 4, 'aka', min(p.key) FROM N n JOIN A a ON {_NM.format('a.alias')} = {_NM.format('n.name')} JOIN P p ON lower(p.name) = a.n GROUP BY 1 UNION ALL SELECT entry, 5, 'near', arg_min(key, (floor(d * 1000), key)) FROM (SELECT n.entry, p.key, {_MEAN} AS d FROM N n JOIN Q p ON n.lat IS NOT NULL) WHERE d < 600 GROUP BY 1), E AS (SELECT N.entry, arg_min(M.key, step) AS key, coalesce(arg_min(how, step), 'none') AS how FROM N LEFT JOIN M ON N.entry = M.entry GROUP BY N.entry)"


def matched_whole(spark, sf, anchor: float = 600.0):
    """Each entry with the place that the first of its keys finds: id, name and town, name, a name worn before, nearest."""
    n = spark.createDataFrame(WHOLE, "entry string, id long, name string, town long, lat double, lng double").withColumn("nm", names.norm(F.col("name")))
    aka = spark.createDataFrame(AKA, "n string, alias string").select("n", names.norm(F.col("alias")).alias("alias"))
    p = view(spark, sf, "P").select("key", "town", "lat", "lng", F.lower("name").alias("low"), names.norm(F.col("name")).alias("p_nm"))
    small = F.broadcast(n)  # entries and names worn before are kept by hand
    found = lambda d, step, how: d.select("entry", F.lit(step).alias("step"), F.lit(how).alias("how"), "key")
    by_name = p.join(small.select("entry", "nm", F.col("town").alias("t")), F.col("p_nm") == F.col("nm"))
    by_aka = p.join(F.broadcast(n.join(aka, F.col("nm") == F.col("alias")).select("entry", "n")), F.col("low") == F.col("n"))
    there = p.select(F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), "key")
    # the join's flat metres are up to 0.3 % shorter, the cosine at the mean latitude moves them less than the rest
    near = radius_join(n.where("lat IS NOT NULL").select("entry", "lat", "lng"), there, F.lit(anchor * 1.01))
    near = near.withColumn("mean", geo.dist_mean(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))).where(F.col("mean") < anchor)
    near = near.groupBy("entry").agg(F.min_by("key", F.struct(F.floor(F.col("mean") * 1000), F.col("key"))).alias("key"))
    steps = [found(p.join(small.select("entry", "id"), F.col("key") == F.col("id")), 1, "id"), found(by_name.where("town = t"), 2, "name+town"), found(by_name, 3, "name"), found(by_aka, 4, "aka"), found(near, 5, "near")]
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    first = every.groupBy("entry").agg(F.min(F.struct("step", "key", "how")).alias("m"))
    return n.select("entry").join(first, "entry", "left").select("entry", F.col("m.key").alias("key"), F.coalesce("m.how", F.lit("none")).alias("how"))


@query("entry_match_chain_aka", prelude("P") + f", {_STEPS} SELECT entry, key, how FROM E")
def entry_match_chain_aka(spark, sf):
    return matched_whole(spark, sf)


@query("audit_summary_aka", prelude("P") + f", {_RULES}, {_STEPS} SELECT (SELECT count(*) FROM E) AS entries, (SELECT count(*) FROM E WHERE how <> 'none') AS matched, (SELECT count(*) FROM V WHERE scope IN (SELECT state FROM P) AND rule NOT IN (SELECT rule FROM P JOIN V ON {_HIT})) AS dead, (SELECT count(*) FROM P WHERE researched) AS researched")
def audit_summary_aka(spark, sf):
    e = matched_whole(spark, sf).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("how") != "none").alias("matched"))
    return audit_summary(spark, sf).select("dead", "researched").join(e).select("entries", "matched", "dead", "researched")  # single rows


ADDED = [(1, "Oak Hill", 3), (2, "Brand New Park", 3), (3, "cedar  beach", 99)]


@query("additions_anti", prelude("P") + f", A AS (SELECT * FROM (VALUES (1, 'Oak Hill', 3), (2, 'Brand New Park', 3), (3, 'cedar  beach', 99)) a(id, name, town)) SELECT id FROM A WHERE NOT EXISTS (SELECT 1 FROM P WHERE {_NM.format('P.name')} = {_NM.format('A.name')} AND P.town = A.town)")
def additions_anti(spark, sf):
    a = spark.createDataFrame(ADDED, "id int, name string, town long").withColumn("nm", names.norm(F.col("name")))
    p = view(spark, sf, "P").select(names.norm(F.col("name")).alias("nm"), "town")
    there = p.join(F.broadcast(a.select("nm", "town")), ["nm", "town"], "left_semi").distinct()  # as many as additions at most
    return a.join(there, ["nm", "town"], "left_anti").select("id")


def publish(places, added):
    """Places with the additions that no (name, town) of theirs holds, first of each kept: a second run changes nothing."""
    keyed = places.withColumn("nm", names.norm(F.col("name")))
    more = added.withColumn("nm", names.norm(F.col("name"))).join(keyed.select("nm", "town"), ["nm", "town"], "left_anti")
    return first_by(keyed.unionByName(more), ["nm", "town"], ["key"]).select("key", "name", "town")


@query("publish_idempotent", prelude("P") + "SELECT 0 AS changed_rows")
def publish_idempotent(spark, sf):
    p = view(spark, sf, "P").select("key", "name", "town")
    added = spark.createDataFrame([(-1, "Brand New Park", 3)], "key long, name string, town long")
    once = publish(p, added)
    twice = publish(once, added)
    return once.exceptAll(twice).unionByName(twice.exceptAll(once)).agg(F.count(F.lit(1)).cast("int").alias("changed_rows"))
