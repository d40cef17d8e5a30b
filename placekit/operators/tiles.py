"""Vector tiles of areas and lines, and archives of tiles.

Features are cut into the tiles that their boxes meet, simplified for the zoom, and encoded tile by tile. An archive holds tiles in
the order of their place on the Hilbert curve, with directories by which a reader finds one with few ranges of bytes.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.functions import shapes

# Units of a tile and drawn past its edge, half the width of the projection, the zooms of layers, share of a pixel
# that a simpler line may be off, and pixels across a tile.
EXTENT, BUFFER, HALF = 4096, 128, 20037508.342789244
LAYER_ZOOMS = {"stateland": (6, 14), "agency": (6, 14), "protected": (8, 14), "preserves": (9, 14), "townparks": (10, 14), "landuse": (10, 14), "cemeteries": (11, 14), "parcels": (12, 14), "trails": (12, 14)}
OTHER_ZOOMS = (10, 14)
OFF, PIXELS = 0.35, 512.0
POINTS, LINES, AREAS = 1, 2, 3
#: Bytes of an archive's head and root directory that a reader asks for first.
FIRST = 16384


def tile_id(z: int, x: int, y: int) -> int:
    """Number of a tile: all of the zooms before, then its place on the Hilbert curve of its zoom."""
    out, n = ((1 << 2 * z) - 1) // 3, 1 << z
    if not (0 <= x < n and 0 <= y < n):
        raise ValueError(f"no tile {z}/{x}/{y}")
    side = n >> 1
    while side:
        right, low = int(x & side > 0), int(y & side > 0)
        out += side * side * ((3 * right) ^ low)
        if not low:
            if right:
                x, y = side - 1 - (x & (side - 1)), side - 1 - (y & (side - 1))
            x, y = y, x
        side >>= 1
    return out


def box_of(z: int, x: int, y: int, pad: float = 0.0) -> tuple[float, float, float, float]:
    """Degrees (x0, y0, x1, y1) of a tile, ``pad`` of its width wider on each side."""
    n = 1 << z
    lat = lambda row: float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * row / n)))))
    wide = 360.0 / n * pad
    return x / n * 360 - 180 - wide, lat(y + 1) - wide, (x + 1) / n * 360 - 180 + wide, lat(y) + wide


def clip_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    return box_of(z, x, y, BUFFER / EXTENT)


def to_tile(points: np.ndarray, z: int, x: int, y: int) -> np.ndarray:
    """Degrees to whole units of a tile, y down; heights go through the projection first."""
    p = np.asarray(points, float).reshape(-1, 2)
    lat = np.radians(np.clip(p[:, 1], -85.05112878, 85.05112878))
    n = 1 << z
    across = (p[:, 0] + 180) / 360 * n - x
    down = (1 - np.log(np.tan(np.pi / 4 + lat / 2)) / np.pi) / 2 * n - y
    return np.rint(np.stack([across, down], 1) * EXTENT).astype(np.int64)


def tolerance(z: int) -> float:
    return 360.0 / (1 << z) / PIXELS * OFF


def least_area(z: int) -> float:
    """A quarter of a pixel, in square degrees."""
    return (360.0 / (1 << z) / PIXELS) ** 2 * 0.25


# ------------------------------------------------------------- encoding of a tile


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(v) -> bytes:
    if isinstance(v, bool):
        return b"\x38" + _varint(int(v))
    if isinstance(v, int):
        return b"\x30" + _varint(_zig(v))
    if isinstance(v, float):
        return b"\x19" + struct.pack("<d", v)
    return _field(1, str(v).encode())


def _signed_area(r: np.ndarray) -> float:
    a, b = r, np.roll(r, -1, 0)
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum()) / 2


def _turned(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Outer rings clockwise as seen, each followed by its holes the other way round; flat ones go."""
    rings = sorted((r for r in rings if len(r) > 2 and _signed_area(r)), key=lambda r: -abs(_signed_area(r)))
    depth = [sum(shapes.holds([o], *(r[0] + 0.01 * (r.mean(0) - r[0]))) for o in rings[:i]) for i, r in enumerate(rings)]
    out = []
    for i, r in enumerate(rings):
        if depth[i] % 2:
            continue
        out.append(r if _signed_area(r) > 0 else r[::-1])
        for j in range(i + 1, len(rings)):
            if depth[j] == depth[i] + 1 and shapes.holds([r], *(rings[j][0] + 0.01 * (rings[j].mean(0) - rings[j][0]))):
                out.append(rings[j] if _signed_area(rings[j]) < 0 else rings[j][::-1])
    return out


def _drawn(paths: list[np.ndarray], kind: int) -> list[int]:
    """Commands of moves and lines, each point as the way from the one before."""
    out, at = [], np.zeros(2, np.int64)
    for p in paths:
        p = p[np.append(True, (np.diff(p, axis=0) != 0).any(1))]
        if kind == AREAS and len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if len(p) < kind:
            continue
        steps = np.diff(np.vstack([at, p]), axis=0)
        at = p[-1]
        flat = [_zig(int(v)) for v in steps.reshape(-1)]
        if kind == POINTS:
            out += [1 | len(p) << 3, *flat]
            continue
        out += [1 | 1 << 3, *flat[:2], 2 | (len(p) - 1) << 3, *flat[2:]]
        if kind == AREAS:
            out.append(7 | 1 << 3)
    return out


def encode_tile(layers: dict[str, list[tuple[int, list[np.ndarray], dict]]]) -> bytes:
    """Layers of features (kind, paths in units of the tile, properties) as a vector tile; a layer without a feature goes."""
    tile = b""
    for name, features in layers.items():
        keys: dict[str, int] = {}
        values: dict[tuple, int] = {}
        body = b""
        for kind, paths, props in features:
            drawn = _drawn(_turned(paths) if kind == AREAS else paths, kind)
            if not drawn:
                continue
            tags = [n for k, v in props.items() if v is not None for n in (keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values)))]
            body += _field(2, _field(2, b"".join(map(_varint, tags))) + b"\x18" + _varint(kind) + _field(4, b"".join(map(_varint, drawn))))
        if body:
            tables = b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
            tile += _field(3, b"\x78\x02" + _field(1, name.encode()) + body + tables + b"\x28" + _varint(EXTENT))
    return tile


# ------------------------------------------------------------- tiles of a table


def _paths(rings) -> list[np.ndarray]:
    return [np.asarray(r, float).reshape(-1, 2) for r in rings]


def cut(kind: int, rings, z: int, x: int, y: int) -> list[np.ndarray]:
    """Paths of a feature in a tile and its border, in units of the tile."""
    box, out = clip_box(z, x, y), []
    for p in _paths(rings):
        if kind == AREAS:
            out.append(shapes.clip_ring(p, box))
        elif kind == LINES:
            out += shapes.clip_line(p, box)
        else:
            out.append(p[(p[:, 0] >= box[0]) & (p[:, 0] <= box[2]) & (p[:, 1] >= box[1]) & (p[:, 1] <= box[3])])
    return [to_tile(p, z, x, y) for p in out if len(p)]


def zooms_of(layer: Column, zooms: list[int]) -> Column:
    """Those of ``zooms`` at which a layer is drawn."""
    of = lambda lo, hi: F.array(*[F.lit(z) for z in zooms if lo <= z <= hi]).cast("array<int>")
    out = of(*OTHER_ZOOMS)
    for name, span in LAYER_ZOOMS.items():
        out = F.when(layer == name, of(*span)).otherwise(out)
    return out


def placed(features: DataFrame, zooms: list[int]) -> DataFrame:
    """Features (layer, kind, rings, props) simplified for each zoom at which they are drawn, once for each tile that their box meets: z, x, y."""

    @F.pandas_udf("struct<rings:array<array<double>>,x0:double,y0:double,x1:double,y1:double,area:double>")
    def simpler(kinds: pd.Series, rings: pd.Series, z: pd.Series) -> pd.DataFrame:
        out = []
        for kind, r, zoom in zip(kinds, rings, z, strict=True):
            paths = [p if kind == POINTS else shapes.simplify(p, tolerance(zoom), 4 if kind == AREAS else 2) for p in _paths(r)]
            every = np.vstack([*paths, np.zeros((0, 2))])
            size = abs(sum(_signed_area(p) for p in _turned(_paths(r)))) if kind == AREAS else 0.0
            corners = [*every.min(0), *every.max(0)] if len(every) else [np.nan] * 4
            out.append(([p.reshape(-1).tolist() for p in paths], *corners, size))
        return pd.DataFrame(out, columns=["rings", "x0", "y0", "x1", "y1", "area"])

    least = F.pow(F.lit(360.0 / PIXELS) / F.pow(F.lit(2.0), F.col("z")), F.lit(2.0)) * 0.25
    drawn = features.withColumn("z", F.explode(zooms_of(F.col("layer"), zooms))).withColumn("s", simpler("kind", "rings", "z"))
    drawn = drawn.where(~F.isnan("s.x0") & ((F.col("kind") != AREAS) | (F.col("s.area") >= least)))
    n = F.pow(F.lit(2.0), F.col("z"))
    column = lambda c: F.least(F.greatest(F.floor((F.col(c) + 180) / 360 * n), F.lit(0)), n.cast("long") - 1)
    tan = lambda c: F.radians(F.least(F.lit(85.0511287), F.greatest(F.lit(-85.0511287), F.col(c))))
    row = lambda c: F.least(F.greatest(F.floor((1 - F.ln(F.tan(tan(c)) + 1 / F.cos(tan(c))) / F.pi()) / 2 * n), F.lit(0)), n.cast("long") - 1)
    drawn = drawn.withColumn("x", F.explode(F.sequence(column("s.x0"), column("s.x1")))).withColumn("y", F.explode(F.sequence(row("s.y1"), row("s.y0"))))
    return drawn.select("z", "x", "y", "layer", "kind", F.col("s.rings").alias("rings"), "props")


def stage(features: DataFrame, zooms: list[int]) -> DataFrame:
    """z, x, y, tile_id, data: every tile as compressed bytes. Features that a tile draws are in one task; others never meet.

    features: layer, kind (POINTS, LINES or AREAS), rings (array of arrays x0, y0, x1, y1, ...), props (map of texts), id (their order in a tile).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(pdf[c].iloc[0]) for c in ("z", "x", "y"))
        layers: dict[str, list] = {}
        for r in pdf.sort_values(["layer", "order"]).itertuples():
            paths = cut(r.kind, r.rings, z, x, y)
            if paths:
                layers.setdefault(r.layer, []).append((r.kind, paths, json.loads(r.props)))
        data = encode_tile(layers)
        return pd.DataFrame([(z, x, y, tile_id(z, x, y), gzip.compress(data, 6, mtime=0))] if data else [], columns=["z", "x", "y", "tile_id", "data"])

    here = placed(features.withColumn("props", F.struct(F.col("id").alias("order"), F.to_json("props").alias("text"))), zooms)
    here = here.select("z", "x", "y", "layer", "kind", "rings", F.coalesce("props.text", F.lit("{}")).alias("props"), F.col("props.order").alias("order"))
    return here.groupBy("z", "x", "y").applyInPandas(run, "z int, x long, y long, tile_id long, data binary")


def latest(stages: DataFrame, order: str) -> DataFrame:
    """Of several stages' tiles the last in ``order`` for each tile_id."""
    return stages.groupBy("tile_id").agg(F.max_by(F.struct("z", "x", "y", "data"), order).alias("t")).select("tile_id", "t.*")


# ------------------------------------------------------------- archives


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """(tile_id, run, length, offset) as a compressed directory; run 0 points to a leaf."""
    out, last, end = [_varint(len(entries))], 0, None
    for t, _, _, _ in entries:
        out.append(_varint(t - last))
        last = t
    out += [_varint(r) for _, r, _, _ in entries]
    out += [_varint(n) for _, _, n, _ in entries]
    for _, _, n, o in entries:
        out.append(_varint(0 if end is not None and o == end else o + 1))
        end = o + n
    return gzip.compress(b"".join(out), mtime=0)


def read_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    raw, at = gzip.decompress(data), 0

    def take() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    many = take()
    ids = np.cumsum([take() for _ in range(many)]).tolist() if many else []
    runs, lengths, offsets = [take() for _ in range(many)], [take() for _ in range(many)], []
    for i in range(many):
        o = take()
        offsets.append(offsets[-1] + lengths[i - 1] if not o and i else o - 1)
    return list(zip(ids, runs, lengths, offsets, strict=True))


def pack(staged: DataFrame, path: str, box: tuple[float, float, float, float], layers: list[str], zooms: tuple[int, int], about: dict | None = None) -> int:
    """One archive of all tiles, in the order of their numbers; the number of tiles.

    Tiles come to the driver a partition at a time; equal tiles are kept once. The directories, some 24 bytes a tile, are held.
    """
    import hashlib
    import os
    import shutil

    body, entries, known, size, count = f"{path}.tiles", [], {}, 0, 0
    with open(body, "wb") as out:
        for r in staged.select("tile_id", "data").orderBy("tile_id").toLocalIterator():
            data, count = bytes(r["data"]), count + 1
            digest = hashlib.sha256(data).digest()
            if digest not in known:
                known[digest] = size
                out.write(data)
                size += len(data)
            at = known[digest]
            if entries and entries[-1][3] == at and entries[-1][0] + entries[-1][1] == r["tile_id"]:
                entries[-1] = (entries[-1][0], entries[-1][1] + 1, entries[-1][2], at)
            else:
                entries.append((r["tile_id"], 1, len(data), at))
    root, leaves, per = _directory(entries), b"", 4096
    while len(root) > FIRST - 127:
        heads, leaves = [], b""
        for i in range(0, len(entries), per):
            leaf = _directory(entries[i : i + per])
            heads.append((entries[i][0], 0, len(leaf), len(leaves)))
            leaves += leaf
        root, per = _directory(heads), per * 2
    low, high = zooms
    extent = lambda n: [max(LAYER_ZOOMS.get(n, OTHER_ZOOMS)[0], low), min(LAYER_ZOOMS.get(n, OTHER_ZOOMS)[1], high)]
    meta = gzip.compress(json.dumps((about or {}) | {"vector_layers": [{"id": n, "fields": {}, "minzoom": extent(n)[0], "maxzoom": extent(n)[1]} for n in sorted(layers)]}).encode(), mtime=0)
    at = [127, len(root), 127 + len(root), len(meta), 127 + len(root) + len(meta), len(leaves), 127 + len(root) + len(meta) + len(leaves), size, count, len(entries), len(known)]
    e7 = [round(v * 1e7) for v in box]
    middle = [round((box[0] + box[2]) / 2 * 1e7), round((box[1] + box[3]) / 2 * 1e7)]
    head = b"PMTiles\x03" + struct.pack("<11Q", *at) + bytes([1, 2, 2, 1, low, high]) + struct.pack("<4i", *e7) + bytes([min(max(9, low), high)]) + struct.pack("<2i", *middle)
    with open(path, "wb") as out, open(body, "rb") as tiles:
        out.write(head + root + meta + leaves)
        shutil.copyfileobj(tiles, out)
    os.remove(body)
    return count


class Archive:
    """Tiles of an archive by ranges of bytes: ``read(start, length)``. Zooms beyond the deepest one take the tile above."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self._read = read
        head = read(0, FIRST)
        if head[:8] != b"PMTiles\x03":
            raise ValueError("no archive of tiles")
        self._at = struct.unpack("<11Q", head[8:96])
        self.zooms = head[100], head[101]
        self._root = read_directory(head[self._at[0] : self._at[0] + self._at[1]])
        self.about = json.loads(gzip.decompress(read(self._at[2], self._at[3])))

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        """The tile, uncompressed; of a deeper zoom, that of the deepest zoom which holds it."""
        if z > self.zooms[1]:
            up = z - self.zooms[1]
            z, x, y = self.zooms[1], x >> up, y >> up
        wanted, entries = tile_id(z, x, y), self._root
        for _ in range(4):
            i = int(np.searchsorted([e[0] for e in entries], wanted, side="right")) - 1
            if i < 0:
                return None
            first, run, length, at = entries[i]
            if run:
                return gzip.decompress(self._read(self._at[6] + at, length)) if wanted < first + run else None
            entries = read_directory(self._read(self._at[4] + at, length))
        raise ValueError("directories too deep")


def open_archive(path: str) -> Archive:
    def read(start: int, length: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(length)

    return Archive(read)


def decode_tile(data: bytes) -> dict[str, list[tuple[int, list[list[tuple[int, int]]], dict]]]:
    """Layers of a tile: kind, paths and properties of each feature."""

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while at < len(raw):
            key = varint()
            if key & 7 == 2:
                n = varint()
                yield key >> 3, raw[at : at + n]
                at += n
            elif key & 7 == 1:
                yield key >> 3, raw[at : at + 8]
                at += 8
            else:
                yield key >> 3, varint()

    def numbers(raw: bytes) -> list[int]:
        out, n, shift = [], 0, 0
        for b in raw:
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                out.append(n)
                n = shift = 0
        return out

    def value(raw: bytes):
        (k, v), *_ = fields(raw)
        return v.decode() if k == 1 else struct.unpack("<d", v)[0] if k == 3 else (v >> 1) ^ -(v & 1) if k == 6 else bool(v)

    out = {}
    for _, layer in fields(data):
        parts = list(fields(layer))
        name = next(v for k, v in parts if k == 1).decode()
        keys, values = [v.decode() for k, v in parts if k == 3], [value(v) for k, v in parts if k == 4]
        features = []
        for _, f in (p for p in parts if p[0] == 2):
            own = dict(fields(f))
            tags, drawn = numbers(own.get(2, b"")), numbers(own[4])
            paths, at, i = [], (0, 0), 0
            while i < len(drawn):
                op, n = drawn[i] & 7, drawn[i] >> 3
                i += 1
                if op == 7:
                    continue
                for _ in range(n):
                    step = [(v >> 1) ^ -(v & 1) for v in drawn[i : i + 2]]
                    at, i = (at[0] + step[0], at[1] + step[1]), i + 2
                    if op == 1:
                        paths.append([])
                    paths[-1].append(at)
            features.append((own[3], paths, {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}))
        out[name] = features
    return out
