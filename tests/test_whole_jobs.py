"""Jobs done whole, against plain versions: where an older query of nearly the same name does less."""

import math
import re

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from placekit.functions import geo, names
from placekit.plans import catalogue, viewer
from placekit.plans.adapter import VIEWS, view

SF = "/root/testdata/sf0.01"


def flat(a, b):
    """Flat distance at the first place's latitude."""
    return math.hypot((b.lat - a.lat) * 111000, (b.lng - a.lng) * 111000 * math.cos(math.radians(a.lat)))


def test_gaps_at_800_metres(spark):
    """Rows that only a place between 800 and 8000 m away would hold stay."""
    p, r = (view(spark, SF, x).withColumn("nm", names.norm(F.col("name"))).select("key", "lat", "lng", "nm").collect() for x in "PR")
    want = {x.key for x in r if not any(y.nm == x.nm and flat(y, x) < 800 for y in p)}
    got = [x.key for x in catalogue.queries()["pad_gap_anti_800m"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 1


def km(a, b):
    """Kilometres on the sphere."""
    h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lng - a.lng) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


def test_articles_up_to_four_kilometres(spark):
    """Articles between 2 and 4 km away count as those near by do."""
    p, c = (view(spark, SF, x).select("key", "lat", "lng", "name").collect() for x in "PC")
    words = {n: {w for w in re.split(" +", re.sub("[^a-z0-9 ]+", " ", n.lower())) if len(w) > 2 and w not in viewer.STOP} for n in {r.name for r in p + c}}
    agree = {(a, b) for a in words for b in words if words[a] & words[b] and len(words[a] & words[b]) >= 0.5 * min(len(words[a]), len(words[b]))}
    want, least = {}, {}
    for x in p:
        met = [(y.key, d) for y in c if (x.name, y.name) in agree and (d := km(x, y)) <= 4]
        if met:
            want[x.key], least[x.key] = min(met)[0], min(d for _, d in met)
    got = [tuple(r) for r in catalogue.queries()["article_gate"](spark, SF).select("key", "article").collect()]
    assert sorted(got) == sorted(want.items())
    assert sum(d > 2.1 for d in least.values()) > 100


def test_articles_of_crowded_blocks(spark, tmp_path):
    """Blocks of many spots, near in part or as a whole, and keys that two rows share: the same rows as SQL."""
    duck = duckdb.connect()
    keys = {}
    for t, role, key, more in (("part", "P", "p_partkey", "CAST((i * 11) % 50 + 1 AS INT) AS p_size"), ("customer", "C", "c_custkey", "'BUILDING' AS c_mktsegment, 100.0 AS c_acctbal, 3 AS c_nationkey")):
        duck.execute(f"CREATE TABLE {t} AS SELECT i AS {key}, {more} FROM range(100000) r(i)")
        duck.execute(f"DELETE FROM {t} WHERE {key} NOT IN (SELECT key FROM ({VIEWS[role]}) WHERE lat BETWEEN 41.1 AND 41.19 AND lng BETWEEN -73.3 AND -73.19)")
        if t == "part":
            duck.execute("INSERT INTO part SELECT p_partkey, p_size + 1 FROM part WHERE p_partkey % 3 = 0")
            duck.execute("INSERT INTO part VALUES (NULL, 5), (7, NULL)")
        duck.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        keys[t] = duck.execute(f"SELECT count(*), count(DISTINCT {key}) FROM {t}").fetchone()
    assert keys["part"][0] > keys["part"][1] + 100 and keys["customer"][0] > 1500
    want = duck.execute(catalogue.oracle_sql()["article_gate"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["article_gate"](spark, str(tmp_path)).select("key", "article").collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_bounds_of_boxes(spark):
    """No two points of two boxes are nearer or farther than the bounds, on either side of the equator."""
    box = lambda y0, y1, x0, x1: f"named_struct('y0', {y0}D, 'y1', {y1}D, 'x0', {x0}D, 'x1', {x1}D)"
    pairs = [((41.0, 41.02, -73.5, -73.48), (41.01, 41.03, -73.47, -73.45)), ((-0.01, 0.02, 5.0, 5.01), (0.03, 0.05, 4.9, 5.005)), ((-60.5, -60.0, 1.0, 2.0), (-59.9, -59.0, 3.0, 3.5)), ((41.0, 41.0, 2.0, 2.0), (41.03, 41.03, 2.01, 2.01))]
    point = lambda b, s, n: (b[0] + (b[1] - b[0]) * (s // n) / (n - 1), b[2] + (b[3] - b[2]) * (s % n) / (n - 1))
    for a, b in pairs:
        least, most = spark.range(1).select(F.expr(box(*a)).alias("a"), F.expr(box(*b)).alias("b")).select(*geo.box_km(F.col("a"), F.col("b"))).first()
        spots = [[Row(lat=y, lng=x) for y, x in (point(z, s, 5) for s in range(25))] for z in (a, b)]
        met = [km(x, y) for x in spots[0] for y in spots[1]]
        assert least <= min(met) + 1e-9 and max(met) <= most + 1e-9
        assert a[0] < a[1] or most - least < 1e-9
