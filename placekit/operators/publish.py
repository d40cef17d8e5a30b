"""The fast path from what is known to what is published: additions, merge, research, verdicts, audit, pruned rows.

Publishing what was published changes nothing: additions that are there aren't added again, merged records stay merged, and verdicts
follow from facts alone.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.functions import geo, names, verdicts
from placekit.operators import merge
from placekit.operators.components import materialize
from placekit.operators.spatial import radius_join

#: Metres from an entry's place within which the nearest record is meant.
ANCHOR = 600.0
#: Facts that research may set, and texts that it may replace.
FACTS = ["trails", "parking", "sports", "playground", "beach", "pool", "reachable", "private"]
TEXTS = ["agency", "url", "fee", "note"]
#: What follows from the rest, and isn't written.
DERIVED = ["access", "fee_state", "why"]


@dataclass
class Audit:
    """What became of every entry and rule."""

    entries: int = 0
    matched: int = 0
    rules: int = 0
    rule_hits: int = 0
    unmatched: list[str] = field(default_factory=list)
    dead_rules: list[str] = field(default_factory=list)
    dormant_rules: list[str] = field(default_factory=list)
    before: int = 0
    after: int = 0
    places: int = 0
    researched: int = 0

    def code(self) -> int:
        """Exit code: 1 if research is lost or a rule is dead."""
        return int(bool(self.unmatched or self.dead_rules))

    def write(self, path: str) -> None:
        with open(path, "w") as out:
            json.dump(asdict(self) | {"exit": self.code()}, out, indent=1)


def add_missing(places: DataFrame, additions: DataFrame) -> DataFrame:
    """``places`` and those additions whose name and town no place has, nor had before a rename. Keys of both are of one kind."""
    worn = F.concat(F.array("name"), F.coalesce("aka", F.array().cast("array<string>")))
    have = places.select(F.explode(worn).alias("n"), F.col("town").alias("h_town")).select(names.norm(F.col("n")).alias("h_name"), "h_town").distinct()
    new = additions.withColumn("__nm", names.norm(F.col("name"))).join(have, (F.col("__nm") == F.col("h_name")) & F.col("town").eqNullSafe(F.col("h_town")), "left_anti").drop("__nm")
    return places.unionByName(new, allowMissingColumns=True)


def apply_rules(places: DataFrame, rules: list[dict], audit: Audit) -> DataFrame:
    """Facts that a cited rule settles for all it matches; a later rule overwrites. A rule speaks for its states only.

    rules: id, match {column: value}, states, facts {fact: True}. Rules are kept by hand, so there are few.
    """
    audit.rules = len(rules)
    tests = []
    for r in rules:
        hit = F.coalesce(F.col("state"), F.lit("CT")).isin(*r.get("states", ["CT"]))
        for k, v in r.get("match", {}).items():
            hit = hit & F.coalesce(F.col(k) == v, F.lit(False))
        tests.append(hit)
    if tests:
        counts = places.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)], F.collect_set(F.coalesce("state", F.lit("CT"))).alias("states")).first()
        audit.rule_hits = sum(counts[f"n{i}"] for i in range(len(rules)))
        for i, r in enumerate(rules):
            if not counts[f"n{i}"]:
                (audit.dead_rules if set(r.get("states", ["CT"])) & set(counts["states"]) else audit.dormant_rules).append(r["id"])
    out = {c: F.col(c) for c in FACTS}
    researched = F.col("researched")
    for r, t in zip(rules, tests, strict=True):
        researched = F.when(t, True).otherwise(researched)
        for fact, value in r.get("facts", {}).items():
            if value is not False:
                out[fact] = F.when(t, value).otherwise(out[fact])
    return places.withColumns(out | {"researched": researched})


def match_entries(places: DataFrame, entries: DataFrame) -> DataFrame:
    """entry, key: by id, by name and town, by name, by a name worn before, by the nearest place within ANCHOR - the first that has one.

    entries: entry, id, name, town, lat, lng. Of several places the first by key.
    """
    e = entries.select("entry", F.col("id").alias("e_id"), names.norm(F.col("name")).alias("e_name"), F.col("town").alias("e_town"), "lat", "lng")
    p = places.select("key", F.col("id").alias("p_id"), names.norm(F.col("name")).alias("p_name"), F.col("town").alias("p_town"), "aka", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    named = e.where("e_name <> ''")
    first = lambda d, *by: d.groupBy(*by).agg(F.min("key").alias("key"))  # noqa: E731  of several places of a name only the first counts
    alt = first(p.select("key", F.explode("aka").alias("alt")).withColumn("alt", names.norm(F.col("alt"))), "alt")
    tries = [
        e.join(p, F.col("e_id") == F.col("p_id")).select("entry", F.lit(0).alias("by"), F.lit(0.0).alias("far"), "key"),
        named.join(first(p, "p_name", "p_town"), (F.col("e_name") == F.col("p_name")) & F.col("e_town").eqNullSafe(F.col("p_town"))).select("entry", F.lit(1), F.lit(0.0), "key"),
        named.join(first(p, "p_name"), F.col("e_name") == F.col("p_name")).select("entry", F.lit(2), F.lit(0.0), "key"),
        named.join(alt, F.col("e_name") == F.col("alt")).select("entry", F.lit(3), F.lit(0.0), "key"),
    ]
    near = radius_join(e.where("lat IS NOT NULL AND lng IS NOT NULL"), p.where("r_lat IS NOT NULL"), F.lit(ANCHOR * 1.02))
    far = geo.dist_mean(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    tries.append(near.withColumn("far", far).where(F.col("far") < ANCHOR).select("entry", F.lit(4), "far", "key"))
    every = tries[0]
    for t in tries[1:]:
        every = every.union(t)
    return every.groupBy("entry").agg(F.min(F.struct("by", "far", "key")).alias("m")).select("entry", F.col("m.key").alias("key"), F.col("m.by").alias("by"))


def apply_entries(places: DataFrame, entries: DataFrame, audit: Audit) -> DataFrame:
    """Facts and texts of research on the place that each entry matches; a fact found false goes. Of several entries of a place the last wins.

    entries: entry, id, name, town, lat, lng, rename, and FACTS and TEXTS that are null where they say nothing.
    """
    found = materialize(match_entries(places, entries))
    lost = entries.join(found, "entry", "left_anti")
    audit.entries, audit.matched = entries.count(), found.count()
    audit.unmatched = [r["name"] for r in lost.orderBy("entry").select("name").collect()]  # entries are kept by hand
    told = entries.join(found, "entry").select("entry", F.col("key").alias("t_key"), F.col("rename").alias("t_rename"), F.col("name").alias("t_name"), *[F.col(c).alias(f"t_{c}") for c in (*FACTS, *TEXTS)])
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("entry", F.col(c).alias("v"))))["v"].alias(c)
    worn = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("t_rename").isNotNull(), F.struct("entry", "t_name")))), lambda s: F.array(s["t_name"])))).alias("t_worn")
    told = told.groupBy("t_key").agg(*[last(c) for c in ("t_rename", *[f"t_{c}" for c in (*FACTS, *TEXTS)])], worn)
    out = places.join(told, F.col("key") == F.col("t_key"), "left")
    facts = {c: F.when(F.col(f"t_{c}").isNotNull(), F.col(f"t_{c}")).otherwise(F.col(c)) for c in (*FACTS, *TEXTS)}
    renamed = F.col("t_rename").isNotNull()
    old = F.array_compact(F.concat(F.col("aka"), F.coalesce("t_worn", F.array().cast("array<string>")), F.array(F.when(renamed, F.col("name")))))
    old = F.filter(F.array_distinct(old), lambda n: names.norm(n) != names.norm(F.coalesce("t_rename", "name")))
    more = {"aka": F.when(renamed, old).otherwise(F.col("aka")), "name": F.coalesce("t_rename", "name"), "researched": F.col("t_key").isNotNull() | F.coalesce("researched", F.lit(False))}
    return out.withColumns(facts | more).select(*places.columns)


def judge(places: DataFrame) -> DataFrame:
    """access, fee_state, status and why of each place, from its facts."""
    out = places.withColumn("access", verdicts.access()).withColumn("fee_state", verdicts.fee_state())
    return out.withColumn("status", verdicts.status()).withColumn("why", verdicts.reasons())


def publish(places: DataFrame, additions: DataFrame, rules: list[dict], entries: DataFrame) -> tuple[DataFrame, Audit]:
    """The rows to publish and their audit.

    places: key, id, name, type, state, town, lat, lng, acres, aka, official, researched, shaped, FACTS and TEXTS. Additions have the same columns, or fewer.
    """
    audit = Audit(before=judge(places).where("status = 'park'").count())
    now = add_missing(places, additions).withColumn("aka", F.coalesce("aka", F.array().cast("array<string>")))
    now = materialize(merge.resolve(now).drop("merged").select(*places.columns))
    now = materialize(apply_entries(apply_rules(now, rules, audit), entries, audit))
    out = materialize(judge(now))
    counts = out.agg(F.count_if(F.col("status") == "park"), F.count(F.lit(1)), F.count_if("researched")).first()
    audit.after, audit.places, audit.researched = counts
    return out.drop(*DERIVED), audit


def stamp(df: DataFrame, path: str, version: str) -> None:
    """The rows as a new version beside the others, with its name and count in the table's own metadata."""
    df.withMetadata("key", {"version": version, "rows": df.count()}).write.parquet(f"{path}/{version}")
