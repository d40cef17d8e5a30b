"""Many rows of one spot: the same rows as SQL, without joins that grow by the square of the copies."""

import duckdb
import pytest

from placekit.plans import catalogue
from placekit.plans.adapter import TABLES

SF = "/root/testdata/sf0.001"
KEYS = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}
QUERIES = [
    "candidate_pairs",
    "shape_relocate",
    "named_access_points",
    "tag_scores",
    "article_gate",
    "boundary_choice",
    "pad_gap_anti",
    "drawn_overlap",
    "coastal_fuzzy_nearest",
    "nearest_water_edge",
    "coastal_group_merge",
    "parking_semi",
    "radius_join_facilities",
    "sports_labels",
]


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """A folder with each place n times on its spot, as spots repeat after 50,000 keys."""

    def made(n: int) -> str:
        out = tmp_path_factory.mktemp(f"copies{n}")
        for t in set(TABLES.values()):
            more = f"SELECT * REPLACE ({KEYS[t]} + i * 50000 AS {KEYS[t]}) FROM '{SF}/{t}.parquet', (SELECT unnest(range({n})) AS i)" if t in KEYS else f"SELECT * FROM '{SF}/{t}.parquet'"
            duckdb.execute(f"COPY (SELECT * {'EXCLUDE (i)' if t in KEYS else ''} FROM ({more})) TO '{out}/{t}.parquet' (FORMAT parquet)")
        return str(out)

    return {n: made(n) for n in (1, 24)}


def joined(spark, run):
    """What ``run`` returns, and the most rows that one join put out meanwhile."""
    sc = spark.sparkContext._jsc.sc()
    store = spark._jsparkSession.sharedState().statusStore()
    sc.listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    got = run()
    sc.listenerBus().waitUntilEmpty(30_000)
    most, done = 0, store.executionsList()
    for i in range(before, done.size()):
        at = done.apply(i).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            rows = [m for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"] if "Join" in node.name() else []
            most = max([most, *[int(values.apply(m.accumulatorId()).replace(",", "")) for m in rows if values.contains(m.accumulatorId())]])
    return got, most


@pytest.mark.parametrize("name", QUERIES)
def test_copies_meet_once(spark, copied, name):
    once, few = joined(spark, lambda: catalogue.queries()[name](spark, copied[1]).collect())
    got, many = joined(spark, lambda: catalogue.queries()[name](spark, copied[24]).collect())
    assert many <= 24 * 2 * max(few, 1), (few, many)
    duck = duckdb.connect()
    for t in set(TABLES.values()):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{copied[24]}/{t}.parquet'")
    want = duck.execute(catalogue.oracle_sql()[name])
    heads = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in heads) for r in got) == sorted(want.fetchall())


def test_records_meet_by_blocks(spark, copied):
    """Every key stays or is taken once, and copies make no more pairs of blocks."""
    names = ("key", "survivor")
    once, few = joined(spark, lambda: catalogue.queries()["entity_survivors"](spark, copied[1]).select(*names).collect())
    got, many = joined(spark, lambda: catalogue.queries()["entity_survivors"](spark, copied[24]).select(*names).collect())
    assert len({r.key for r in got}) == len(got) and not {r.key for r in got} & {r.survivor for r in got}
    assert len(got) > 24 * len(once) and many <= 24 * 2 * max(few, 200), (few, many)
