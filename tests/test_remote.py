"""Services that fail, are slow or give nothing; kept answers; samples; lists and towns read and written."""

import json
import time

import pytest
from pyspark.sql import functions as F

from placekit.sources import remote, sections


def _fail():
    raise OSError("down")


def test_first_and_race():
    assert remote.first_of([_fail, lambda: [], lambda: [1]]) == [1]
    with pytest.raises(OSError):
        remote.first_of([lambda: [], _fail])
    assert remote.race([_fail, lambda: time.sleep(0.05) or "b"]) == "b"
    with pytest.raises(OSError):
        remote.race([_fail])
    with pytest.raises(TimeoutError):
        remote.race([lambda: time.sleep(1)], 0.05)
    with pytest.raises(TimeoutError):
        remote.bounded(lambda: time.sleep(1), 0.05)
    assert remote.bounded(lambda: 3, 5) == 3


def test_union_bears_a_failure(spark):
    out, lost = remote.union_of({"a": lambda: spark.range(2), "b": _fail, "c": lambda: spark.range(1).withColumn("x", F.lit(1))})
    assert lost == ["b"] and sorted((r.id, r.of, r.x) for r in out.collect()) == [(0, "a", None), (0, "c", 1), (1, "a", None)]
    assert remote.union_of({"b": _fail}) == (None, ["b"])


def test_pages():
    rows, asked = list(range(25)), []

    def page(at, size):
        asked.append(at)
        if asked.count(10) == 1 and at == 10:
            raise OSError("once")
        return rows[at : at + size], at + size < len(rows)

    assert list(remote.pages(page, 10, wait=0)) == rows and asked == [0, 10, 10, 20]
    with pytest.raises(ValueError):
        list(remote.pages(lambda at, size: ([], False), 10, wait=0))


def test_samples_come_back_by_place_or_order(spark):
    def ask(points):
        got = [{"value": lat * 10 + lng, "locationId": i} for i, (lat, lng) in enumerate(points) if lat < 9]
        return got[::-1] if len(points) % 2 else [{"value": g["value"]} for g in got]

    points = spark.createDataFrame([(k, i, float(k), float(i)) for k in range(12) for i in range(4)], "key long, i int, lat double, lng double")
    got = {(r.key, r.i): r.value for r in remote.sample_points(points, ask, batch=3, parts=2).collect()}
    assert all(got[k, i] == (k * 10 + i if k < 9 else None) for k in range(9) for i in range(4) if got[k, i] is not None) and len(got) == 48
    z = {r.key: (r.mean, r.relief, r.n) for r in remote.zonal(spark.createDataFrame([(1, 5.0), (1, 7.0), (1, -500.0), (1, 9.0), (2, 1.0)], "key long, value double")).collect()}
    assert z == {1: (7.0, 4.0, 3)}


def test_windows_of_pixels(spark):
    def ask(lat, lng, radius):
        if lat < 0:
            raise OSError("no image")
        return [(10, 200, 10, 255)] * 3 + [(0, 0, 250, 255)] + [(0, 0, 250, 10)] + [(255, 0, 255, 255)]

    places = spark.createDataFrame([(1, 1.0, 1.0, 5.0), (2, -1.0, 1.0, 5.0)], "key long, lat double, lng double, radius double")
    w = remote.sample_windows(places, ask, {"grass": (0, 200, 0), "water": (0, 0, 255)}, wait=0, parts=2)
    assert sorted((r.key, r.cls, r.n) for r in w.collect()) == [(1, "grass", 3), (1, "water", 1)]
    assert sorted((r.group, r.percent) for r in remote.shares(w, {"grass": "open", "water": "water"}).collect()) == [("open", 75), ("water", 25)]


def test_kept_answers(spark, tmp_path):
    clock = [1000.0]
    kept = remote.Kept(spark, str(tmp_path / "kept"), 60, lambda: clock[0])
    asked = []

    def fetch(n):
        def go():
            asked.append(n)
            return spark.range(n)

        return go

    assert kept.get("a", fetch(3)).count() == 3 and kept.get("a", fetch(4)).count() == 3 and asked == [3]
    clock[0] += 100
    assert kept.get("a", fetch(5)).count() == 5 and kept.get("a", fetch(9), baked=spark.range(2)).count() == 2
    clock[0] += 100
    with pytest.raises(ValueError):
        kept.get("a", fetch(0))
    assert kept.get_or_last("a", fetch(0))[1] and kept.get_or_last("a", _fail)[0].count() == 5 and len(kept.versions("a")) == 2
    rows, stale = kept.get_or_last("a", fetch(7))
    assert rows.count() == 7 and not stale
    with pytest.raises(OSError):
        kept.get_or_last("b", _fail)
    kept.get("c", fetch(1))
    assert kept.prune(["a"]) == ["a/v1000", "c"] and kept.versions("a")[-1] == 1200 and kept.versions("c") == []


def test_towns_lists_and_writers(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"geometry": {"type": "Polygon", "coordinates": [square, [[1, 0.2], [1.1, 0.2], [1, 0.3], [1, 0.2]]]}, "properties": {"TOWN": "Elm"}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}, "properties": {"NAME": "Oak", "state": "NY"}},
        {"geometry": {"type": "Point", "coordinates": [1, 1]}, "properties": {"NAME": "no"}},
    ]}
    (tmp_path / "t.geojson").write_text(json.dumps(doc))
    got = sorted((r["name"], r.state, r.part, r.x0, r.y1, len(r.ring)) for r in remote.outer_rings(spark, str(tmp_path / "t.geojson")).collect())
    assert got == [("Elm", "CT", 0, 0.0, 1.0, 5), ("Oak", "NY", 0, 0.0, 1.0, 5), ("Oak", "NY", 1, 5.0, 6.0, 4)]
    (tmp_path / "s.json").write_text(json.dumps({"parks": [{"n": "Elm", "t": "State Park", "lat": 41, "lng": -73, "a": 12, "source": ["x"]}, {"n": "nowhere"}]}))
    r = remote.static_places(spark, str(tmp_path / "s.json")).collect()
    assert [(x["name"], x.subtype, x.acres, x.researched) for x in r] == [("Elm", "State Park", 12.0, True)]
    features = spark.createDataFrame([("Point", "[1,2]", {"name": 'a "b"'}), ("Point", "[3,4]", None)], "type string, coordinates string, properties map<string,string>")
    remote.write_layer(features, str(tmp_path / "l.geojson"))
    back = json.loads((tmp_path / "l.geojson").read_text())
    assert [f["geometry"]["coordinates"] for f in back["features"]] == [[1, 2], [3, 4]] and back["features"][0]["properties"]["name"] == 'a "b"'
    assert remote.write_listing(spark.range(3), str(tmp_path / "r.json"), ["id"], {"from": "x"}) == 3
    assert json.loads((tmp_path / "r.json").read_text()) == {"from": "x", "rows": [{"id": 0}, {"id": 1}, {"id": 2}]}


def test_views_of_a_map(spark):
    d = spark.createDataFrame([(1, 41.0, -73.0), (2, 42.0, -73.0)], "key long, lat double, lng double")
    assert [r.key for r in remote.in_view(d, (-74, 40, -72, 41.5), 12).collect()] == [1] and remote.in_view(d, (-74, 40, -72, 43), 8).count() == 0


def test_sections_of_a_service(spark):
    """A layer of two may fail; a section without an answer takes the last run's rows, or fails."""
    raw = spark.createDataFrame([(1, {"ACCSS_NAME": "Ramp"}, 1.0, 2.0, None, None), (2, {"ACCSS_NAME": "ramp"}, 1.0, 2.0, None, None)], "seq long, attributes map<string,string>, x double, y double, cx double, cy double")

    def read(layer, section):
        assert section.where and section.fields
        if layer != "launches_carried":
            raise OSError("down")
        return raw

    before = spark.createDataFrame([("old",)], "n string")
    out, stale = sections.fetch(spark, read, ["boats", "parking"], lambda name: before if name == "parking" else None)
    assert [(r.n, r.lat, r.lng) for r in out["boats"].collect()] == [("Ramp", 2.0, 1.0)] and stale == ["parking"] and out["parking"].first().n == "old"
    with pytest.raises(RuntimeError):
        sections.fetch(spark, read, ["water"])


def test_features_without_a_number(spark):
    from placekit.sources.tiled import identity

    rows = [(1, {"OBJECTID": "7", "n": "a"}, 1.0, 2.0), (2, {"n": "b", "OBJECTID": "7"}, 9.0, 9.0), (3, {"n": "a", "m": "c"}, 1.0, 2.0), (4, {"m": "c", "n": "a"}, 1.0000001, 2.0), (5, {"m": "c", "n": "a"}, 1.1, 2.0), (6, None, None, None)]
    d = spark.createDataFrame(rows, "i int, attributes map<string,string>, x double, y double")
    ids = {r.i: r.k for r in d.select("i", identity(F.col("attributes"), F.col("x"), F.col("y")).alias("k")).collect()}
    assert ids[1] == ids[2] and ids[3] == ids[4] != ids[5] and len(set(ids.values())) == 4 and None not in ids.values()
