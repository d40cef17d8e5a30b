"""Areas of any shape against samples of points and plain loops; tiles and archives read back."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from placekit.functions import shapes
from placekit.operators import polygons, tiles


def star(rng, n=12, at=(0.0, 0.0), size=1.0):
    """A ring without crossings, in and out."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.3, 1.0, n) * size
    p = np.stack([at[0] + r * np.cos(turn), at[1] + r * np.sin(turn)], 1)
    return np.vstack([p, p[:1]])


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:]):
            odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / ((by - ay) or 1) * (bx - ax))
    return odd


def test_common_area_by_sampling():
    rng = np.random.default_rng(1)
    g = (np.arange(600) + 0.5) / 600 * 4 - 2
    x, y = (v.ravel() for v in np.meshgrid(g, g))
    for _ in range(12):
        a = [star(rng), star(rng, 6, size=0.25)]
        b = [star(rng, 9, rng.uniform(-1, 1, 2))]
        want = (inside(a, x, y) & inside(b, x, y)).mean() * 16
        assert abs(shapes.common_area(a, b) - want) < 0.01
        assert abs(shapes.area(b) - abs(tiles._signed_area(b[0][:-1]))) < 1e-9
        assert shapes.touch(a, b) or want == 0
        px, py = rng.uniform(-1, 1, 2)
        assert shapes.holds(a, px, py) == inside(a, np.array([px]), np.array([py]))[0]


def test_clip_and_simplify():
    rng = np.random.default_rng(2)
    box = (-0.4, -0.3, 0.5, 0.2)
    frame = np.array([[-0.4, -0.3], [0.5, -0.3], [0.5, 0.2], [-0.4, 0.2], [-0.4, -0.3]])
    for _ in range(20):
        r = star(rng)
        c = shapes.clip_ring(r, box)
        assert abs(abs(tiles._signed_area(c)) if len(c) > 2 else 0.0) == pytest.approx(shapes.common_area([r], [frame]), abs=1e-9)
        line = star(rng, 40)
        s = shapes.simplify(line, 0.1, 4)
        assert (s[0] == s[-1]).all() and len(s) <= len(line)
        for p in line:  # no point is farther than allowed from what stays
            d = []
            for a, b in zip(s[:-1], s[1:]):
                t = np.clip((p - a) @ (b - a) / max(((b - a) ** 2).sum(), 1e-300), 0, 1)
                d.append(np.hypot(*(p - a - t * (b - a))))
            assert min(d) <= 0.1 + 1e-9
    parts = shapes.clip_line(np.array([[-2, 0], [0, 0], [0, 2], [0.1, 2], [0.1, -2]]), (-1, -1, 1, 1))
    assert [p.tolist() for p in parts] == [[[-1, 0], [0, 0], [0, 1]], [[0.1, 1], [0.1, -1]]]


def test_mask_and_burn():
    ring = np.array([[1, 1], [6, 1], [6, 5], [3, 3], [1, 5], [1, 1]], float)
    m = shapes.mask([ring], 8, 6)
    for j in range(6):
        for i in range(8):
            assert m[j, i] == inside([ring], np.array([i + 0.5]), np.array([j + 0.5]))[0]
    assert shapes.burn(np.array([[0.5, 0.5], [3.5, 0.5], [3.5, 9]]), 5, 4).tolist() == [[0, 0], [1, 0], [2, 0], [3, 0], [3, 1], [3, 2], [3, 3]]


def _areas(spark, rng, n):
    rows = [(int(rng.integers(0, 3)), i, ["elm", "oak", "fir", ""][rng.integers(0, 4)], [star(rng, 8, rng.uniform(0, 0.4, 2), 0.08).reshape(-1).tolist()]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"layer int, id long, name string, rings {polygons.RINGS}")


def test_layers_against_a_plain_fold(spark):
    rows, frame = _areas(spark, np.random.default_rng(5), 90)
    kept, want = [], {}
    for layer in range(3):
        now = []
        for _, i, name, rings in (r for r in rows if r[0] == layer):
            mine = [np.reshape(r, (-1, 2)) for r in rings]
            named = name and any(n == name and shapes.touch(mine, o) for n, o in kept)
            covered = sum(shapes.common_area(mine, o) for _, o in kept)
            want[i] = "name" if named else "overlap" if covered / shapes.area(mine) >= 0.55 else "kept"
            if want[i] == "kept":
                now.append((name, mine))
        kept += now
    got = {r.id: r.reason for r in polygons.dedupe_layers(frame, [0, 1, 2]).collect()}
    assert got == want and set(want.values()) == {"kept", "name", "overlap"}


def test_places_in_concave_areas(spark):
    rng = np.random.default_rng(6)
    rows, frame = _areas(spark, rng, 60)
    places = [(i, float(rng.uniform(0, 0.4)), float(rng.uniform(0, 0.4)), ["elm", "oak", "yew"][i % 3]) for i in range(120)]
    got = {r.key: r for r in polygons.shape_places(spark.createDataFrame(places, "key long, lat double, lng double, name string"), frame).collect()}
    areas = [(layer, i, name, [np.reshape(r, (-1, 2)) for r in rings]) for layer, i, name, rings in rows]
    for key, lat, lng, name in places:
        held = [a for a in areas if shapes.holds(a[3], lng, lat)]
        middle = lambda a: ((a[3][0][:, 1].min() + a[3][0][:, 1].max()) / 2, (a[3][0][:, 0].min() + a[3][0][:, 0].max()) / 2)
        far = lambda a: 111000 * np.hypot(middle(a)[0] - lat, (middle(a)[1] - lng) * np.cos(np.radians(lat)))
        near = [a for a in areas if a[2] == name and far(a) < 8000]
        own = [a for a in held if a[2] == name]
        if not held and not near:
            assert key not in got
            continue
        moved = not own and bool(near)
        best = min(own or near, key=lambda a: (a[0], a[1]))[0] if own or near else None
        at = round(middle(max(near, key=lambda a: (shapes.area(a[3]), -a[1])))[0], 5) if moved else lat
        size = sum(shapes.area(a[3]) for a in areas if a[0] == best and a[2] == name) if best is not None else min(shapes.area(a[3]) for a in held)
        assert got[key].moved == moved and got[key].lat == pytest.approx(at) and got[key].acres == pytest.approx(size * np.cos(np.radians(at)) * polygons.ACRES)


def test_tile_numbers_fill_each_zoom():
    assert tiles.tile_id(0, 0, 0) == 0 and [tiles.tile_id(1, x, y) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]
    for z in (2, 3, 5):
        n, first = 1 << z, ((1 << 2 * z) - 1) // 3
        at = {tiles.tile_id(z, x, y): (x, y) for x in range(n) for y in range(n)}
        assert sorted(at) == list(range(first, first + n * n))
        assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(first, first + n * n - 1))


def test_tiles_are_read_back(spark, tmp_path):
    ring = [[-73.0, 41.0, -72.9, 41.0, -72.9, 41.1, -73.0, 41.1, -73.0, 41.0], [-72.97, 41.03, -72.95, 41.03, -72.95, 41.05, -72.97, 41.05, -72.97, 41.03]]
    rows = [(1, "stateland", tiles.AREAS, ring, {"name": "Elm", "kind": "park"}), (2, "trails", tiles.LINES, [[-73.0, 41.0, -72.9, 41.1]], {"name": "Path"}), (3, "stateland", tiles.AREAS, [[0.0, 0.0, 1e-9, 0.0, 0.0, 1e-9, 0.0, 0.0]], {}), (4, "pois", tiles.POINTS, [[-72.95, 41.05]], None)]
    features = spark.createDataFrame(rows, "id long, layer string, kind int, rings array<array<double>>, props map<string,string>")
    staged = tiles.stage(features, [6, 10, 12])
    path = str(tmp_path / "a.tiles")
    n = tiles.pack(staged, path, (-73, 41, -72, 42), ["stateland", "trails", "pois"], (6, 12))
    archive = tiles.open_archive(path)
    assert n == staged.count() and archive.zooms == (6, 12) and {x["id"] for x in archive.about["vector_layers"]} == {"stateland", "trails", "pois"}
    total = 0
    for r in staged.collect():
        data = archive.tile(r.z, r.x, r.y)
        assert data == gzip.decompress(bytes(r.data)) and r.tile_id == tiles.tile_id(r.z, r.x, r.y)
        layers = tiles.decode_tile(data)
        assert not layers.keys() - {"stateland", "trails", "pois"} and (r.z > 11 or "trails" not in layers)
        for kind, paths, props in layers.get("stateland", []):
            assert kind == tiles.AREAS and props == {"name": "Elm", "kind": "park"} and np.abs(np.concatenate(paths)).max() <= 4096 + 180
            if r.z == 6:
                back = [np.array(p, float) for p in paths]
                assert tiles._signed_area(back[0]) > 0
                total += 1
    assert total == 1 and archive.tile(6, 0, 0) is None and archive.tile(14, *[v << 2 for v in _any(staged, 12)]) is not None


def _any(staged, z):
    r = staged.where(F.col("z") == z).first()
    return r.x, r.y


def test_holes_turn_the_other_way():
    outer, hole, island = (np.array([[a, a], [b, a], [b, b], [a, b]], float) for a, b in ((0, 100), (20, 80), (40, 60)))
    turned = tiles._turned([island, hole[::-1], outer])
    assert [np.sign(tiles._signed_area(r)) for r in turned] == [1, -1, 1] and len(turned) == 3


def test_later_stages_win_and_large_archives_have_leaves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiles, "FIRST", 2000)
    a = spark.range(3).selectExpr("id AS tile_id", "0 AS z", "id AS x", "id AS y", "encode('old', 'utf-8') AS data", "1 AS run")
    b = a.where("tile_id = 1").selectExpr("tile_id", "z", "x", "y", "encode('new', 'utf-8') AS data", "2 AS run")
    assert {r.tile_id: bytes(r.data) for r in tiles.latest(a.unionByName(b), "run").collect()} == {0: b"old", 1: b"new", 2: b"old"}
    many = spark.range(30_000).selectExpr("id * 7 AS tile_id", "encode(repeat(concat('t', id * id), cast(1 + abs(hash(id)) % 9 as int)), 'utf-8') AS data")
    path = str(tmp_path / "b.tiles")
    assert tiles.pack(many, path, (0, 0, 1, 1), [], (0, 9)) == 30_000
    archive = tiles.open_archive(path)
    for t in (0, 7 * 1234, 7 * 29_999):
        i = t // 7
        entries = archive._root
        k = int(np.searchsorted([e[0] for e in entries], t, side="right")) - 1
        assert entries[k][1] == 0
        leaf = tiles.read_directory(archive._read(archive._at[4] + entries[k][3], entries[k][2]))
        k = int(np.searchsorted([e[0] for e in leaf], t, side="right")) - 1
        assert leaf[k][0] == t and archive._read(archive._at[6] + leaf[k][3], leaf[k][2]) .startswith(f"t{i * i}".encode())


def test_columns_of_shapes(spark):
    rng = np.random.default_rng(8)
    rows, frame = _areas(spark, rng, 10)
    got = polygons.corners(frame).select("id", "x0", "y1", polygons.holds(F.col("rings"), F.lit(0.2), F.lit(0.2)).alias("in"), polygons.simpler("rings", F.lit(0.02)).alias("s"), polygons.clipped("rings", F.lit(0.0), F.lit(0.0), F.lit(0.2), F.lit(0.2)).alias("c")).collect()
    for r, (_, i, _, rings) in zip(sorted(got), rows, strict=True):
        p = np.reshape(rings[0], (-1, 2))
        assert r.id == i and r.x0 == p[:, 0].min() and r.y1 == p[:, 1].max() and r["in"] == shapes.holds([p], 0.2, 0.2)
        assert len(r.s[0]) <= len(rings[0]) and all(0 <= v <= 0.2 for c in r.c for v in c)
