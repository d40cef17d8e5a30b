"""Data source, files, streaming, geometry and names on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from placekit.functions import geo, names
from placekit.operators.spatial import radius_join
from placekit.sources import files, tiled


class Grid:
    """A service of 400 points of which one page fails once, and whose large counts fail."""

    def __init__(self, config):
        self.points = [{"id": i, "x": i % 20 + 0.5, "y": i // 20 + 0.5} for i in range(400)]
        self.failed, self.lost = set(), config.get("lost")

    def inside(self, box):
        return [p for p in self.points if box[0] <= p["x"] <= box[2] and box[1] <= p["y"] <= box[3]]

    def count(self, box):
        if box[2] - box[0] > 9:
            raise OSError("no count")
        return len(self.inside(box))

    def page(self, box, offset, n):
        if self.lost or box not in self.failed:
            self.failed.add(box)
            raise OSError("once")
        return self.inside(box)[offset : offset + n]


def options(**more):
    return {"service": "tests.test_modules:Grid", "box": json.dumps([0, 0, 20, 20]), "grid": "2", "limit": "30", "page": "7", "wait": "0", **more}


def test_tiled_source_reads_each_row_once(spark):
    got = tiled.read_service(spark, "id long, x double, y double", "id", **options())
    assert sorted(r.id for r in got.collect()) == list(range(400))


def test_tiled_source_never_loses_rows_silently(spark):
    with pytest.raises(Exception, match="once"):
        tiled.read_service(spark, "id long, x double, y double", "id", **options(config='{"lost": true}')).collect()


def test_leaves_cover_the_box():
    boxes = tiled.leaves(Grid({}), (0, 0, 20, 20), 30, 4)
    assert sum((b[2] - b[0]) * (b[3] - b[1]) for b in boxes) == 400
    assert all(len(Grid({}).inside(b)) <= 30 for b in boxes)


def test_snapshot_is_kept_when_a_source_fails(spark, tmp_path):
    where = str(tmp_path)
    with pytest.raises(ValueError, match="no rows"):
        files.read_or_last(spark, lambda: spark.range(0), where)
    assert [r.stale for r in files.read_or_last(spark, lambda: spark.range(3), where).collect()] == [False] * 3

    def fail():
        raise OSError("down")

    assert [r.stale for r in files.read_or_last(spark, fail, where).collect()] == [True] * 3


def test_geojson_layers(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": " A ", "note": " "}}]}
    (tmp_path / "ep-parks.geojson").write_text(json.dumps(shape))
    r = files.read_layers(spark, f"{tmp_path}/ep-*.geojson").select("layer", "type", files.clean_properties(F.col("properties")).alias("p")).first()
    assert (r.layer, r.type, r.p) == ("parks", "Point", {"name": "A"})


def test_places_file_has_no_empty_values(spark, tmp_path):
    p = spark.createDataFrame([(1, "", False, "open"), (2, "x", True, "closed"), (3, None, True, "open")], "key int, note string, trails boolean, access string")
    files.write_places(p, f"{tmp_path}/out")
    got = sorted(json.loads(r.value)["key"] for r in spark.read.text(f"{tmp_path}/out").collect())
    lines = "".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert got == [1, 3] and "null" not in lines and "false" not in lines and '""' not in lines


def test_stream_equals_batch(spark, tmp_path):
    from placekit.streaming.events import windowed_counts

    src = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{src}/events.parquet")
    last = batch.agg(F.max("ts")).first()[0]
    stream = spark.readStream.schema(batch.schema).parquet(f"{src}/events.parque[t]")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("events_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination()
    assert last and sorted(spark.table("events_out").collect()) == sorted(windowed_counts(batch).collect())


def test_window_reaches_east_and_west(spark):
    a = spark.createDataFrame([(1, 41.5, -73.0)], "key int, lat double, lng double")
    b = spark.createDataFrame([(2, 41.5, -73.0 + 900 / (111000 * 0.7489557)), (3, 41.5, -73.03)], "r_key int, r_lat double, r_lng double")
    assert [r.r_key for r in radius_join(a, b, F.lit(1040.0)).collect()] == [2]


def test_polygon_with_a_notch(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    d = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], px, py) for px, py in ((0.5, 3.0), (3.0, 0.5), (3.0, 3.0))], "ring array<struct<x:double,y:double>>, x double, y double")
    assert [tuple(r) for r in d.select(geo.inside(F.col("ring"), F.col("x"), F.col("y")), geo.shoelace(F.col("ring"))).collect()] == [(True, 7.0), (True, 7.0), (False, 7.0)]


@pytest.mark.parametrize(("a", "b", "want"), [("Oak Hill Preserve", "Hill Oak", True), ("Fox Run North", "Fox Run", True), ("Oak Hill", "Oak Pond", False), ("The Park", "Park", True), ("", "Oak", False)])
def test_related_names(spark, a, b, want):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(names.related(names.tokens(F.col("a")), names.tokens(F.col("b")))).first()[0] is want


def test_components(spark):
    from placekit.operators.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    assert {(r.node, r.label) for r in connected_components(edges).collect()} == {(i, 1) for i in range(1, 31)} | {(i, 100) for i in (100, 101, 102)}
