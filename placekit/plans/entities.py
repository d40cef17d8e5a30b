"""Entity resolution to a fixed point, with its survivors, folded facts and ids."""

from pyspark.sql import functions as F

from placekit.operators import merge, publish
from placekit.plans import shapes
from placekit.plans.adapter import view
from placekit.plans.registry import query


def records(spark, sf):
    """Places as records to be merged."""
    p = view(spark, sf, "P")
    flags = [c for c in (*merge.FACTS, "researched", "shaped", "private") if c in p.columns]
    return p.select(
        "key", "name", "type", "lat", "lng", F.col("acres").cast("double").alias("acres"), F.col("op").alias("agency"), "url", F.col("town").cast("string").alias("town"), "fee", *flags
    )


@query("entity_resolution")
def entity_resolution(spark, sf):
    """One row for each place that stays: its name, other names, keys taken, id and facts after the merge."""
    out = merge.resolve(records(spark, sf))
    facts = [F.when(F.col(c), c) for c in sorted(merge.FACTS) if c in out.columns]
    return out.select("key", "id", "name", "lat", "lng", "acres", F.array_join("aka", "; ").alias("aka"), F.array_join(F.transform("merged", lambda k: k.cast("string")), ",").alias("merged"), F.concat_ws(",", *facts).alias("facts"), "agency", "url", "fee")


@query("entity_survivors")
def entity_survivors(spark, sf):
    """For each key taken by another record: the key that stays."""
    return merge.resolve(records(spark, sf)).select(F.explode("merged").alias("key"), F.col("key").alias("survivor"), "id")


@query("gap_ranking")
def gap_ranking(spark, sf):
    """The largest 400 groups of trail cells that no place holds, with acres of about 6.7 a cell."""
    groups = shapes.gap_clusters_in_towns(spark, sf)
    return groups.orderBy(F.col("size").desc(), "cluster").limit(400).select("cluster", "size", F.floor(F.col("size") * 6.7 + 0.5).alias("acres"))


def facts(spark, sf):
    """Places as they come to be published."""
    p = view(spark, sf, "P").withColumns({"aka": F.array().cast("array<string>"), "id": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "town": F.col("town").cast("string"), "acres": F.col("acres").cast("double")})
    return p.select("key", "id", "name", "type", "state", "town", "lat", "lng", "acres", "aka", "official", "researched", "shaped", F.col("op").alias("agency"), "url", "fee", "note", *publish.FACTS)


#: Rules and research for the places of the tables.
RULES = [{"id": "walk-in", "match": {"type": "cemetery"}, "facts": {"reachable": True}}, {"id": "leave", "match": {"type": "preserve"}, "states": ["CT", "NY"], "facts": {"reachable": True}}]


def added(spark, sf):
    """Additions and research: suppliers as places, customers as entries about places near them."""
    r = view(spark, sf, "R").select((F.col("key") + 10_000_000).alias("key"), F.concat("name", F.lit(" Annex")).alias("name"), F.lit("town").alias("type"), F.lit("CT").alias("state"), (F.col("key") % 40).cast("string").alias("town"), "lat", "lng")
    e = view(spark, sf, "C").where("sport IS NULL").select(F.col("key").cast("int").alias("entry"), F.lit(None).cast("string").alias("id"), "name", (F.col("key") % 40).cast("string").alias("town"), "lat", "lng", F.lit(None).cast("string").alias("rename"), *[F.lit(True if c == "trails" else None).cast("boolean").alias(c) for c in publish.FACTS], *[F.lit(None).cast("string").alias(c) for c in publish.TEXTS])
    return r, e


@query("publish_rows")
def publish_rows(spark, sf):
    """Rows published from places, additions, rules and research."""
    out, _ = publish.publish(facts(spark, sf), added(spark, sf)[0], RULES, added(spark, sf)[1])
    return out.select("key", "id", "name", "status", "researched", F.size("aka").alias("worn"), *publish.FACTS)
