"""From facts to published rows: the same again when published again, and an account of every entry."""

import json

import pytest
from pyspark.sql import functions as F

from placekit.operators import publish as pub
from placekit.plans.adapter import view

SF = "/root/testdata/sf0.001"
RULES = [
    {"id": "cemeteries", "match": {"type": "cemetery"}, "facts": {"reachable": True}},
    {"id": "northern", "match": {"type": "preserve"}, "states": ["NY"], "facts": {"reachable": True, "beach": False}},
    {"id": "dead", "match": {"type": "nothing"}, "facts": {"reachable": True}},
    {"id": "dormant", "match": {"type": "state"}, "states": ["VT"], "facts": {"reachable": True}},
]
ENTRY = "entry int, id string, name string, town string, lat double, lng double, rename string, trails boolean, parking boolean, sports boolean, playground boolean, beach boolean, pool boolean, reachable boolean, private boolean, agency string, url string, fee string, note string"


def places(spark):
    p = view(spark, SF, "P").withColumns({"aka": F.array().cast("array<string>"), "id": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "town": F.col("town").cast("string"), "acres": F.col("acres").cast("double")})
    return p.select("key", "id", "name", "type", "state", "town", "lat", "lng", "acres", "aka", "official", "researched", "shaped", F.col("op").alias("agency"), "url", "fee", "note", *pub.FACTS)


def entry(n, **told):
    return tuple({"entry": n, **told}.get(c.split()[0]) for c in ENTRY.split(", "))


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def once(spark):
    additions = spark.createDataFrame([(10_001, "Far New Place", "town", "CT", "99", 45.0, -70.0), (10_002, "Oak Hill", "town", "CT", None, 45.5, -70.5)], "key long, name string, type string, state string, town string, lat double, lng double")
    entries = spark.createDataFrame([entry(1, name="Far New Place", town="99", trails=True, rename="Far Place"), entry(2, name="nobody knows this", lat=45.5001, lng=-70.5, fee="$9 admission fee"), entry(3, name="lost", lat=1.0, lng=1.0)], ENTRY)
    return additions, entries, pub.publish(places(spark), additions, RULES, entries)


def test_account(once, tmp_path):
    _, _, (out, audit) = once
    assert (audit.entries, audit.matched, audit.unmatched) == (3, 2, ["lost"])
    assert audit.dead_rules == ["dead"] and audit.dormant_rules == ["dormant"] and audit.code() == 1
    assert audit.rule_hits == out.where("type = 'cemetery' AND state = 'CT' OR type = 'preserve' AND state = 'NY'").count()
    audit.write(str(tmp_path / "audit.json"))
    told = json.loads((tmp_path / "audit.json").read_text())
    assert told["exit"] == 1 and told["places"] == out.count() and told["after"] >= told["before"]


def test_rows(once):
    _, _, (out, _) = once
    r = {x["name"]: x for x in out.where("key > 10000").collect()}
    assert set(r) == {"Far Place", "Oak Hill"} and r["Far Place"].aka == ["Far New Place"] and r["Far Place"].trails and r["Far Place"].researched
    assert r["Oak Hill"].fee == "$9 admission fee" and r["Oak Hill"].status == "fee"
    assert out.where("type = 'cemetery' AND coalesce(state, 'CT') = 'CT' AND NOT reachable").count() == 0
    assert not set(pub.DERIVED) & set(out.columns) and out.where("id IS NULL").count() == 0


def test_published_again_nothing_changes(spark, once):
    additions, entries, (out, audit) = once
    again, second = pub.publish(out.drop("status"), additions, RULES, entries)
    assert rows(again) == rows(out) and (second.after, second.places) == (audit.after, audit.places) and second.before == audit.after


def test_match_chain(spark):
    p = spark.createDataFrame([(1, "a1", "Elm Wood", "7", ["Old Elm"], 41.0, -73.0), (2, "b2", "Elm Wood", "8", [], 41.1, -73.0), (3, "c3", "Oak", "7", ["Elm Wood"], 41.2, -73.0)], "key long, id string, name string, town string, aka array<string>, lat double, lng double")
    e = spark.createDataFrame([entry(1, id="c3", name="Elm Wood", town="7"), entry(2, name="elm  wood", town="8"), entry(3, name="Elm Wood", town="nowhere"), entry(4, name="OLD ELM"), entry(5, name="?", lat=41.2004, lng=-73.0), entry(6, name="?", lat=41.206, lng=-73.0)], ENTRY)
    assert {r.entry: (r.key, r.by) for r in pub.match_entries(p, e).collect()} == {1: (3, 0), 2: (2, 1), 3: (1, 2), 4: (1, 3), 5: (3, 4)}


def test_stamp(spark, tmp_path):
    pub.stamp(spark.range(3).withColumnRenamed("id", "key"), str(tmp_path / "t"), "v1")
    assert spark.read.parquet(str(tmp_path / "t/v1")).schema["key"].metadata == {"version": "v1", "rows": 3}
