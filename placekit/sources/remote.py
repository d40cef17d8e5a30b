"""Asking services: bounded calls, the first that answers, unions that bear a failure, pages, batches of points, kept answers.

A service is any Python callable. Calls that a table needs many of run in the tasks of a DataFrame; only catalogues and small lists
are asked for by the driver.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLong

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placekit.sources.tiled import attempt


def bounded(call: Callable, seconds: float):
    """``call()``, or TimeoutError if it takes longer; the call itself can't be stopped, only left."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(seconds)
    except TooLong:
        raise TimeoutError(f"no answer in {seconds} s") from None
    finally:
        pool.shutdown(wait=False)


def first_of(calls: Iterable[Callable], good: Callable = bool):
    """The first answer that is ``good``, one service after the other; the last failure if none is."""
    failure: Exception = LookupError("no service has an answer")
    for call in calls:
        try:
            got = call()
            if good(got):
                return got
        except Exception as e:  # a service may fail in any way
            failure = e
    raise failure


def race(calls: list[Callable], seconds: float = 20.0):
    """The first answer of several services asked at once."""
    pool, end, failure = ThreadPoolExecutor(max(1, len(calls))), time.monotonic() + seconds, None
    waiting = [pool.submit(c) for c in calls]
    try:
        while waiting and time.monotonic() < end:
            for f in [f for f in waiting if f.done()]:
                waiting.remove(f)
                if f.exception() is None:
                    return f.result()
                failure = f.exception()
            time.sleep(0.005)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    raise failure or TimeoutError(f"no answer in {seconds} s")


def union_of(calls: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """The rows of all that answer, marked with their names, and the names of those that don't; None if none does."""
    out, lost = None, []
    for name, call in calls.items():
        try:
            part = call().withColumn("of", F.lit(name))
            part.schema  # noqa: B018  a source that can't be read fails here
        except Exception:
            lost.append(name)
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, lost


def pages(page: Callable[[int, int], tuple[list, bool]], size: int, tries: int = 3, wait: float = 1.5) -> Iterator:
    """All rows of ``page(offset, size) -> (rows, more)``. A short page without more is the last; no row at all is an error."""
    at = 0
    while True:
        rows, more = attempt(lambda: page(at, size), tries, wait)
        yield from rows
        at += len(rows)
        if not rows or (len(rows) < size and not more):
            break
    if not at:
        raise ValueError("a service that has rows gave none")


def sample_points(points: DataFrame, ask: Callable[[list[tuple[float, float]]], list[dict]], batch: int = 80, tries: int = 3, wait: float = 1.5, parts: int = 64) -> DataFrame:
    """(key, i, lat, lng) -> key, i, value: values of a raster at points, asked for in batches.

    An answer is {"value"} with "locationId", the place of its point in the batch; without one it counts by its order. A point without an answer has no value.
    A batch that fails for good fails the task, so that no place is silently empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values: list = [None] * len(b)
            for lo in range(0, len(b), batch):
                part = list(zip(b["lat"][lo : lo + batch], b["lng"][lo : lo + batch], strict=True))
                for order, got in enumerate(attempt(lambda: ask(part), tries, wait)):  # noqa: B023
                    at = got.get("locationId", order)
                    if 0 <= at < len(part) and got.get("value") is not None:
                        values[lo + at] = float(got["value"])
            yield pd.DataFrame({"key": b["key"], "i": b["i"], "value": pd.array(values, dtype="Float64")})

    dealt = points.select(F.col("key").cast("long"), F.col("i").cast("int"), "lat", "lng").repartition(parts, "key").sortWithinPartitions("key", "i")
    return dealt.mapInPandas(run, "key long, i int, value double")


def zonal(samples: DataFrame, least: int = 3, low: float = -100.0) -> DataFrame:
    """key, mean, relief, n of samples above ``low``; places with fewer than ``least`` are left out."""
    good = samples.where(F.col("value") > low)
    out = good.groupBy("key").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("relief"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def sample_windows(places: DataFrame, ask: Callable[[float, float, float], list[tuple[int, int, int, int]]], palette: dict[str, tuple[int, int, int]], far: int = 60, tries: int = 3, wait: float = 0.5, parts: int = 64) -> DataFrame:
    """(key, lat, lng, radius) -> key, cls, n: pixels of one small image for each place, each by the nearest colour of the palette.

    A pixel is (r, g, b, alpha); clear ones, and those of no colour within ``far``, are none. An image that can't be had after ``tries`` leaves its place out.
    """
    names, colours = list(palette), list(palette.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    pixels = attempt(lambda: ask(r.lat, r.lng, r.radius), tries, wait)  # noqa: B023
                except Exception:
                    continue
                found: dict[str, int] = {}
                for red, green, blue, alpha in pixels:
                    off = [(red - x) ** 2 + (green - y) ** 2 + (blue - z) ** 2 for x, y, z in colours]
                    best = min(range(len(off)), key=off.__getitem__)
                    if alpha >= 60 and off[best] <= far * far:
                        found[names[best]] = found.get(names[best], 0) + 1
                out += [(r.key, cls, n) for cls, n in found.items()]
            yield pd.DataFrame(out, columns=["key", "cls", "n"])

    return places.select(F.col("key").cast("long"), "lat", "lng", "radius").repartition(parts, "key").mapInPandas(run, "key long, cls string, n long")


def shares(windows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """key, group, percent: pixels of a place by group of classes, in whole percent of all its pixels."""
    of = F.lit(None).cast("string")
    for cls, group in groups.items():
        of = F.when(F.col("cls") == cls, group).otherwise(of)
    by = windows.withColumn("group", of).groupBy("key", "group").agg(F.sum("n").alias("n"))
    total = windows.groupBy(F.col("key").alias("t_key")).agg(F.sum("n").alias("total"))
    out = by.where("group IS NOT NULL").join(total, F.col("key") == F.col("t_key"))
    return out.select("key", "group", F.floor(100 * F.col("n") / F.col("total") + 0.5).alias("percent"))


# ------------------------------------------------------------- towns and lists


def outer_rings(spark: SparkSession, path: str) -> DataFrame:
    """name, state, part, x0, y0, x1, y1, ring of areas in a feature collection: outer rings alone, one row for each part.

    The name is the first of NAME, TOWN, name, town that is there; a state that isn't named is ``CT``.
    """
    from placekit.sources.files import FEATURES

    raw = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties")
    many = F.when(F.col("type") == "MultiPolygon", F.col("coordinates")).otherwise(F.concat(F.lit("["), F.col("coordinates"), F.lit("]")))
    parts = raw.where(F.col("type").isin("Polygon", "MultiPolygon")).withColumn("parts", F.from_json(many, "array<array<array<array<double>>>>"))
    p = F.col("properties")
    filled = lambda k: F.when(p[k] != "", p[k])
    name, state = F.coalesce(*[filled(k) for k in ("NAME", "TOWN", "name", "town")]), F.coalesce(filled("state"), filled("STATE"), F.lit("CT"))
    rows = parts.select(name.alias("name"), state.alias("state"), F.posexplode("parts").alias("part", "rings")).withColumn("pairs", F.get("rings", F.lit(0)))
    rows = rows.withColumn("ring", F.transform("pairs", lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    x, y = F.transform("ring", lambda c: c["x"]), F.transform("ring", lambda c: c["y"])
    return rows.select("name", "state", "part", F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"), "ring")


def static_places(spark: SparkSession, path: str, field: str = "parks") -> DataFrame:
    """Rows of a list kept by hand: name, subtype, town, lat, lng, acres, url, fee, agency, note, trails, parking, researched."""
    kind = f"{field} array<struct<n:string,type:string,t:string,town:string,lat:double,lng:double,a:double,url:string,fee:string,agency:string,note:string,trails:boolean,parking:boolean,source:array<string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).selectExpr(f"inline({field})")
    return rows.select(F.col("n").alias("name"), "type", F.col("t").alias("subtype"), "town", "lat", "lng", F.col("a").alias("acres"), "url", "fee", "agency", "note", "trails", "parking", F.coalesce(F.size("source") > 0, F.lit(False)).alias("researched")).where("name IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")


def in_view(df: DataFrame, box: tuple[float, float, float, float], zoom: int, least: int = 11) -> DataFrame:
    """Rows (lat, lng) of a view; none where it is too far away to draw them."""
    if zoom < least:
        return df.limit(0)
    x0, y0, x1, y1 = box
    return df.where(F.col("lat").between(y0, y1) & F.col("lng").between(x0, x1))


def allowed_or_unknown(c: Column, shut: list[str]) -> Column:
    """A filter that a service pushes down: missing counts as allowed."""
    return c.isNull() | ~c.isin(*shut)


# ------------------------------------------------------------- kept answers


class Kept:
    """Answers under a folder, a version for each time they were fetched: baked ones first, then fresh ones, then the service.

    A version counts once it is whole; an empty answer is never kept. ``now`` gives seconds.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float, now: Callable[[], float] = time.time) -> None:
        self._spark, self._folder, self._seconds, self._now = spark, folder.rstrip("/"), seconds, now

    def _fs(self, path: str):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._spark._jsc.hadoopConfiguration()), at

    def versions(self, name: str) -> list[int]:
        """Seconds of the whole versions, oldest first."""
        fs, at = self._fs(f"{self._folder}/{name}")
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(self._spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str, version: int) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}/v{version}")

    def write(self, name: str, rows: DataFrame) -> int:
        """A new version beside the others: a failure leaves them as they are."""
        version = max([int(self._now()), *(v + 1 for v in self.versions(name))])
        rows.write.parquet(f"{self._folder}/{name}/v{version}")
        return version

    def get(self, name: str, fetch: Callable[[], DataFrame], baked: DataFrame | None = None) -> DataFrame:
        if baked is not None and baked.limit(1).count():
            return baked
        have = self.versions(name)
        if have and self._now() - have[-1] < self._seconds:
            return self.read(name, have[-1])
        version = self.write(name, fetch())
        if not self.read(name, version).limit(1).count():
            self.drop(name, version)
            raise ValueError(f"{name}: no rows")
        return self.read(name, version)

    def get_or_last(self, name: str, fetch: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """A fresh answer, or the last one and True; the failure if there is no last one."""
        have = self.versions(name)
        try:
            version = self.write(name, fetch())
            if not self.read(name, version).limit(1).count():
                self.drop(name, version)
                raise ValueError(f"{name}: no rows")
            return self.read(name, version), False
        except Exception:
            if not have:
                raise
            return self.read(name, have[-1]), True

    def drop(self, name: str, version: int) -> None:
        fs, at = self._fs(f"{self._folder}/{name}/v{version}")
        fs.delete(at, True)

    def prune(self, keep: list[str], versions: int = 2) -> list[str]:
        """Names that are not on the list go, and of the others all but the last versions; what went."""
        fs, at = self._fs(self._folder)
        gone = []
        for name in sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []:
            if name not in keep:
                fs.delete(self._spark._jvm.org.apache.hadoop.fs.Path(at, name), True)
                gone.append(name)
                continue
            for v in self.versions(name)[:-versions]:
                self.drop(name, v)
                gone.append(f"{name}/v{v}")
        return gone


# ------------------------------------------------------------- writers


def write_layer(features: DataFrame, path: str) -> None:
    """Features (type, coordinates as JSON, properties) as one feature collection, written as they come to the driver."""
    with open(path, "w") as out:
        out.write('{"type":"FeatureCollection","features":[')
        for n, r in enumerate(features.select("type", "coordinates", F.to_json("properties").alias("properties")).toLocalIterator()):
            out.write(f'{"," if n else ""}{{"type":"Feature","geometry":{{"type":{json.dumps(r["type"])},"coordinates":{r["coordinates"]}}},"properties":{r["properties"] or "{}"}}}')
        out.write("]}")


def write_listing(rows: DataFrame, path: str, order: list[str], about: dict) -> int:
    """Rows in order with a head that says where they come from, as one JSON document; how many."""
    n = 0
    with open(path, "w") as out:
        out.write(json.dumps(about)[:-1] + (", " if about else "") + '"rows":[')
        for r in rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("row")).toLocalIterator():
            out.write(("," if n else "") + r["row"])
            n += 1
        out.write("]}")
    return n
