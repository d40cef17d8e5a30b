"""Every query with SQL against DuckDB on the smallest tables, and the rest against brute force."""

import math
from collections import defaultdict

import duckdb
import pytest

from placekit.functions import names
from placekit.plans import catalogue
from placekit.plans.adapter import TABLES, VIEWS, view

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in {*TABLES.values(), "events", "documents"}:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    heads = [d[0] for d in want.description]
    assert sorted(heads) == sorted(got.columns)
    cols = sorted(heads)
    assert rows(cols, [r.asDict() for r in got.collect()]) == rows(cols, [dict(zip(heads, r, strict=True)) for r in want.fetchall()])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6


def test_suppression_against_brute_force(spark):
    from pyspark.sql import functions as F

    from placekit.plans.gates import richness

    p = view(spark, SF, "P").withColumn("rich", richness()).withColumn("nm", names.norm(F.col("name"))).collect()
    groups = defaultdict(list)
    for r in sorted(p, key=lambda r: (-r.rich, r.key)):
        near = [k for k in groups[r.nm] if math.hypot((k.lat - r.lat) * 111000, (k.lng - r.lng) * 111000 * math.cos(math.radians(r.lat))) < 800]
        if not near:
            groups[r.nm].append(r)
    want = {k.key for g in groups.values() for k in g}
    assert {r.key for r in catalogue.queries()["dedupe_nms_800m"](spark, SF).collect()} == want


def test_clusters_against_union_find(spark):
    from placekit.plans.joins import trail_cells

    cells = {(r.ci, r.cj) for r in trail_cells(spark, SF).collect()}
    seen, sizes = set(), []
    for c in cells:
        todo, size = [c], 0
        while todo:
            x = todo.pop()
            if x in seen or x not in cells:
                continue
            seen.add(x)
            size += 1
            todo += [(x[0] + i, x[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if size >= 4:
            sizes.append(size)
    assert sorted(r["size"] for r in catalogue.queries()["gap_clusters"](spark, SF).collect()) == sorted(sizes)


def test_all_roles_are_read(spark):
    assert all(view(spark, SF, r).count() for r in VIEWS)


def test_shapes_in_turn_against_a_plain_fold(spark):
    from pyspark.sql import functions as F

    c = view(spark, SF, "C").select("key", "lat", "lng", "rad", names.norm(F.col("name")).alias("nm")).collect()
    r = view(spark, SF, "R").select("lat", "lng", names.norm(F.col("name")).alias("nm")).collect()
    drawn, added = [(x.lat, x.lng, x.nm) for x in r], set()
    for x in sorted(c):
        far = [(math.hypot((la - x.lat) * 111000, (ln - x.lng) * 111000 * math.cos(math.radians(x.lat))), nm) for la, ln, nm in drawn]
        if not any((nm and nm == x.nm and d < 1600) or d < min(400, max(90, x.rad * 0.28)) for d, nm in far):
            drawn.append((x.lat, x.lng, x.nm))
            added.add(x.key)
    assert {y.key for y in catalogue.queries()["shapes_in_turn"](spark, SF).collect()} == added and len(added) < len(c)


def test_concave_queries_have_rows(spark):
    for name in ("concave_layers", "concave_places", "concave_clips", "tile_stage", "entity_survivors", "gap_ranking", "random_place"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.01" if name == "gap_ranking" else SF).count() > 0, name
