"""A paged spatial service as a Spark data source, with adaptive tiles and retries.

``partitions`` splits the box into four while a tile counts more than ``limit`` rows (or its count
fails), to a depth; each tile is read by pages in its own task. A page is tried ``tries`` times, then its
tile is split again; what is still lost is raised, so a scan is whole or fails. Rows that tiles
share at their borders carry an id and are dropped by ``read_service``.
"""

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Box = tuple[float, float, float, float]


def split(box: Box, n: int = 2) -> list[Box]:
    """n x n equal parts of a box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    xs, ys = ([a + (b - a) * i / n for i in range(n)] + [b] for a, b in ((x0, x1), (y0, y1)))
    return [(xs[i], ys[j], xs[i + 1], ys[j + 1]) for j in range(n) for i in range(n)]


def attempt(call, tries: int = 4, wait: float = 1.5):
    """``call()``, again after a growing wait while it fails."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(wait * (i + 1))


def leaves(service, box: Box, limit: int, depth: int) -> list[Box]:
    try:
        small = service.count(box) <= limit
    except Exception:
        small = False
    if small or not depth:
        return [box]
    return [leaf for part in split(box) for leaf in leaves(service, part, limit, depth - 1)]


@dataclass
class Tile(InputPartition):
    box: Box

    def __init__(self, box: Box) -> None:
        super().__init__(box)
        self.box = box


class TiledReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        module, _, name = options["service"].partition(":")
        self.service = getattr(importlib.import_module(module), name)(json.loads(options.get("config", "{}")))

    def partitions(self) -> list[Tile]:
        tiles = split(tuple(json.loads(self.options["box"])), int(self.options.get("grid", "3")))
        return [Tile(leaf) for t in tiles for leaf in leaves(self.service, t, int(self.options.get("limit", "4000")), int(self.options.get("depth", "4")))]

    def read(self, partition: Tile) -> Iterator[tuple]:
        yield from self._tile(partition.box, 2)

    def _tile(self, box: Box, again: int) -> Iterator[tuple]:
        """Rows page by page. A page that is lost for good has its tile split and read again; ``read_service`` drops what came twice."""
        page, wait, at = int(self.options.get("page", "1000")), float(self.options.get("wait", "1.5")), 0
        while True:
            try:
                got = attempt(lambda: self.service.page(box, at, page), wait=wait)  # noqa: B023
            except Exception:
                if not again:
                    raise
                for part in split(box):
                    yield from self._tile(part, again - 1)
                return
            yield from (tuple(r.get(f.name) for f in self.schema.fields) for r in got)
            at += len(got)
            if len(got) < page:
                return


class TiledService(DataSource):
    """Options: service (module:class), config (JSON), box, grid, limit, depth, page, wait."""

    @classmethod
    def name(cls) -> str:
        return "tiled"

    def reader(self, schema: StructType) -> TiledReader:
        return TiledReader(schema, self.options)


def identity(attributes: Column, x: Column, y: Column) -> Column:
    """What tells a feature: its number if it has one, else its place to six digits and all its attributes."""
    number = F.coalesce(*[attributes[k] for k in ("OBJECTID", "objectid", "OID", "FID")])
    bag = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes))))
    spot = F.concat_ws(",", F.coalesce(F.round(x, 6).cast("string"), F.lit("-")), F.coalesce(F.round(y, 6).cast("string"), F.lit("-")))
    return F.coalesce(F.concat(F.lit("id "), number), F.concat(F.lit("at "), spot, F.lit(" "), F.coalesce(bag, F.lit(""))))


def read_service(spark: SparkSession, schema: str, key: str | None = None, **options) -> DataFrame:
    """Whole scan of a service: each feature once, by its key; without one by ``identity`` of its attributes, x and y."""
    spark.dataSource.register(TiledService)
    rows = spark.read.format("tiled").schema(schema).options(**options).load()
    if key:
        return rows.dropDuplicates([key])
    return rows.withColumn("__id", identity(F.col("attributes"), F.col("x"), F.col("y"))).dropDuplicates(["__id"]).drop("__id")
