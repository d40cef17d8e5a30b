"""Grids of cells: areas filled, paths drawn, neighbours, boxes of pixels, runs inside a mask."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from placekit.plans.adapter import prelude, view
from placekit.plans.joins import towns
from placekit.plans.registry import query

# Degrees of a cell, how far a point snaps, metres of a storey and the most metres of a building.
CELL, SNAP, STOREY, HIGHEST = 0.01, 4, 3.2, 120.0

_FIRST = f"CAST(ceil({{0}} / CAST({CELL} AS DOUBLE) - 0.5) AS BIGINT)"


@query("mask_fill", prelude("M") + f", Y AS (SELECT id, x0, x1, unnest(range({_FIRST.format('y0')}, {_FIRST.format('y1')})) AS ci FROM M) SELECT id, ci, {_FIRST.format('x0')} AS cj, {_FIRST.format('x1')} - {_FIRST.format('x0')} AS n FROM Y")
def mask_fill(spark, sf):
    """Runs of cells whose middle an area holds, row by row: where the row's middle line crosses edges, sorted, in pairs."""
    first = lambda v: F.ceil(v / F.lit(CELL) - 0.5)
    m = towns(spark, sf).withColumn("ci", F.explode(F.sequence(first(F.col("y0")), first(F.col("y1")) - 1)))
    y = (F.col("ci") + 0.5) * F.lit(CELL)

    def crossing(i):
        a, b = F.element_at("ring", i), F.element_at("ring", i + 1)
        meets = (a["y"] > y) != (b["y"] > y)
        return F.when(meets, a["x"] + (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) * (b["x"] - a["x"]))

    xs = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(1), F.size("ring") - 1), crossing)))
    m = m.select("id", "ci", xs.alias("xs")).withColumn("k", F.explode(F.sequence(F.lit(1), (F.size("xs") / 2).cast("int"))))
    low, high = first(F.element_at("xs", 2 * F.col("k") - 1)), first(F.element_at("xs", 2 * F.col("k")))
    return m.where(high > low).select("id", "ci", low.alias("cj"), (high - low).alias("n"))


_PATH = "O AS MATERIALIZED (SELECT path, key, floor((lng + 73.5) * 400) / 4 AS x, floor((lat - 41) * 400) / 4 AS y FROM Q), S AS (SELECT path, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM O WINDOW w AS (PARTITION BY path ORDER BY key)), E AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(nx - x), abs(ny - y)))) AS BIGINT) AS n FROM S WHERE nx IS NOT NULL)"


def _steps(spark, sf):
    """Edges of the paths in units of cells: from, to, and steps of the longer axis. A path is in one task, as each edge needs the next point."""
    o = view(spark, sf, "O").select("path", "key", (F.floor((F.col("lng") + 73.5) * 400) / 4).alias("x"), (F.floor((F.col("lat") - 41) * 400) / 4).alias("y"))
    w = Window.partitionBy("path").orderBy("key")
    e = o.select("path", "x", "y", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny")).where("nx IS NOT NULL")
    return e.withColumn("n", F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(F.abs(F.col("nx") - F.col("x")), F.abs(F.col("ny") - F.col("y"))))))


_Q = prelude("O").replace("WITH O AS", "WITH Q AS").rstrip() + ", "


@query("path_cells", _Q + _PATH + ", C AS (SELECT path, floor(x + k / CAST(n AS DOUBLE) * (nx - x)) AS gx, floor(y + k / CAST(n AS DOUBLE) * (ny - y)) AS gy FROM (SELECT *, unnest(range(n + 1)) AS k FROM E)) SELECT path, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, count(*) AS n FROM C GROUP BY 1, 2, 3")
def path_cells(spark, sf):
    """Cells that paths pass, a step of the longer axis at a time."""
    e = _steps(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    part = F.col("k") / F.col("n").cast("double")
    cells = e.select("path", F.floor(F.col("x") + part * (F.col("nx") - F.col("x"))).alias("gx"), F.floor(F.col("y") + part * (F.col("ny") - F.col("y"))).alias("gy"))
    return cells.groupBy("path", "gx", "gy").agg(F.count(F.lit(1)).alias("n"))


_MASK = "K AS (SELECT DISTINCT CAST(floor((lng + 73.5) * 100) AS BIGINT) AS gx, CAST(floor((lat - 41) * 100) AS BIGINT) AS gy FROM P), A AS (SELECT key, CAST(floor((lng + 73.5) * 100) AS BIGINT) AS gx, CAST(floor((lat - 41) * 100) AS BIGINT) AS gy FROM C)"


def _cell(df, *more):
    return df.select(*more, F.floor((F.col("lng") + 73.5) * 100).alias("gx"), F.floor((F.col("lat") - 41) * 100).alias("gy"))


@query("snap_inside", prelude("P", "C") + f", {_MASK} SELECT a.key, k.gx AS sx, k.gy AS sy FROM A a JOIN K k ON abs(k.gx - a.gx) <= {SNAP} AND abs(k.gy - a.gy) <= {SNAP} QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY greatest(abs(k.gx - a.gx), abs(k.gy - a.gy)), k.gy - a.gy, k.gx - a.gx) = 1")
def snap_inside(spark, sf):
    """The cell of the mask nearest to a point, up to four rings of cells away; in a ring by rows."""
    mask = _cell(view(spark, sf, "P")).distinct().withColumnsRenamed({"gx": "sx", "gy": "sy"})
    ways = F.array(*[F.struct(F.lit(max(abs(dx), abs(dy))).alias("r"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dx in range(-SNAP, SNAP + 1) for dy in range(-SNAP, SNAP + 1)])
    a = _cell(view(spark, sf, "C"), "key").withColumn("w", F.explode(ways)).withColumn("tx", F.col("gx") + F.col("w.dx")).withColumn("ty", F.col("gy") + F.col("w.dy"))
    met = a.join(mask, (F.col("tx") == F.col("sx")) & (F.col("ty") == F.col("sy")))
    return met.groupBy("key").agg(F.min_by(F.struct("sx", "sy"), "w").alias("s")).select("key", "s.sx", "s.sy")


_GRID = "G AS (SELECT key, px, min(v) AS v FROM L GROUP BY key, px)"


def _grid(spark, sf):
    """One value for each cell."""
    return view(spark, sf, "L").groupBy("key", "px").agg(F.min("v").alias("v"))


@query("drop_and_edge", prelude("L") + f", {_GRID}, N AS (SELECT key + dy AS key, px + dx AS px, v FROM G, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS d(dy, dx)) SELECT g.key, g.px, g.v - least(g.v, min(n.v)) AS drop, count(n.v) < 4 AS edge FROM G g LEFT JOIN N n ON n.key = g.key AND n.px = g.px GROUP BY g.key, g.px, g.v")
def drop_and_edge(spark, sf):
    """How far a cell stands over the lowest of its four neighbours, and whether one is missing. A cell is sent to each neighbour once."""
    g = _grid(spark, sf)
    ways = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    sent = g.withColumn("w", F.explode(ways)).select((F.col("key") + F.col("w.dy")).alias("key"), (F.col("px") + F.col("w.dx")).cast("int").alias("px"), F.lit(None).cast("long").alias("v"), F.col("v").alias("n"))
    every = g.withColumn("n", F.lit(None).cast("long")).unionByName(sent)
    out = every.groupBy("key", "px").agg(F.max("v").alias("v"), F.min("n").alias("low"), F.count("n").alias("many")).where("v IS NOT NULL")
    return out.select("key", "px", (F.col("v") - F.least("v", "low")).alias("drop"), (F.col("many") < 4).alias("edge"))


@query("texture_box_mean", prelude("L") + ", C AS (SELECT key, px, v, unnest(range(greatest(0, px - 2), least(7, px) + 1)) AS gx FROM L) SELECT key, CAST(gx AS BIGINT) AS gx, CAST(floor(avg(v) * 1000) AS BIGINT) AS mean_e3, count(*) AS n FROM C GROUP BY key, gx")
def texture_box_mean(spark, sf):
    """Mean of the pixels in the box of each cell; a pixel is sent to the cells whose box holds it."""
    l = view(spark, sf, "L").withColumn("gx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("px").cast("int") - 2), F.least(F.lit(7), F.col("px").cast("int")))))  # noqa: E741
    return l.groupBy("key", F.col("gx").cast("long").alias("gx")).agg(F.floor(F.avg("v") * 1000).alias("mean_e3"), F.count(F.lit(1)).alias("n"))


@query("cover_grid", prelude("L") + ", G AS (SELECT unnest(range(12)) AS gx), S AS (SELECT gx, CAST(least(6, floor(gx / CAST(11 AS DOUBLE) * 6)) + 1 AS BIGINT) AS px FROM G) SELECT l.key, s.gx, l.cls FROM S s JOIN L l ON l.px = s.px WHERE l.stat <> 'F' OR l.v >= 3")
def cover_grid(spark, sf):
    """The class of the pixel nearest to each cell of a finer grid; pixels that show through are none."""
    cells = F.array(*[F.struct(F.lit(gx).cast("long").alias("gx"), F.lit(int(min(6, gx / 11 * 6)) + 1).alias("px")) for gx in range(12)])
    l = view(spark, sf, "L").where("stat <> 'F' OR v >= 3")  # noqa: E741
    own = F.filter(cells, lambda c: c["px"] == F.col("px"))
    return l.select("key", F.explode(own).alias("c"), "cls").select("key", "c.gx", "cls")


@query("burn_max", prelude("C") + f", H AS (SELECT CAST(floor((lng + 73.5) * 100) AS BIGINT) AS gx, CAST(floor((lat - 41) * 100) AS BIGINT) AS gy, key, leisure, CASE WHEN rad % 4 = 0 THEN least({HIGHEST}, rad / 2.0) WHEN rad % 4 = 1 THEN least({HIGHEST}, (rad % 50) * {STOREY}) END AS high FROM C) SELECT gx, gy, CAST(floor(max(high) * 10 + 0.5) AS BIGINT) AS high_dm, arg_max(leisure, key) AS court FROM H GROUP BY gx, gy")
def burn_max(spark, sf):
    """In each cell the highest building - its height, else its storeys - and the last court drawn."""
    rad = F.col("rad")
    high = F.when(rad % 4 == 0, F.least(F.lit(HIGHEST), rad / 2.0)).when(rad % 4 == 1, F.least(F.lit(HIGHEST), (rad % 50) * STOREY))
    c = _cell(view(spark, sf, "C"), "key", "leisure", high.alias("high"))
    return c.groupBy("gx", "gy").agg(F.floor(F.max("high") * 10 + 0.5).alias("high_dm"), F.max_by("leisure", "key").alias("court"))


_RUNS = (
    "K AS (SELECT DISTINCT CAST(floor((lng + 73.5) * 20) AS BIGINT) AS kx, CAST(floor((lat - 41) * 20) AS BIGINT) AS ky FROM R), T AS (SELECT o.path, o.key, (o.lng + 73.5) * 100 AS x, (o.lat - 41) * 100 AS y, k.kx IS NOT NULL AS hit FROM O o LEFT JOIN K k ON floor((o.lng + 73.5) * 20) = kx AND floor((o.lat - 41) * 20) = ky), "
    "N AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY key) - row_number() OVER (PARTITION BY path, hit ORDER BY key) AS run, lag(x) OVER (PARTITION BY path ORDER BY key) AS px, lag(y) OVER (PARTITION BY path ORDER BY key) AS py, lag(hit) OVER (PARTITION BY path ORDER BY key) AS before FROM T)"
)


@query("longest_run", prelude("O", "R") + f", {_RUNS}, U AS (SELECT path, run, min(key) AS first, count(*) AS n, CAST(floor(sum(CASE WHEN before THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) ELSE 0 END) * 1000 + 0.5) AS BIGINT) AS long_e3 FROM N WHERE hit GROUP BY path, run) SELECT path, first, n, long_e3 FROM U WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY path ORDER BY long_e3 DESC, first) = 1")
def longest_run(spark, sf):
    """The longest part of each path that stays inside the mask. A path is in one task, as its points follow each other."""
    mask = view(spark, sf, "R").select(F.floor((F.col("lng") + 73.5) * 20).alias("kx"), F.floor((F.col("lat") - 41) * 20).alias("ky")).distinct()
    o = view(spark, sf, "O").select("path", "key", ((F.col("lng") + 73.5) * 100).alias("x"), ((F.col("lat") - 41) * 100).alias("y"), F.floor((F.col("lng") + 73.5) * 20).alias("ox"), F.floor((F.col("lat") - 41) * 20).alias("oy"))
    t = o.join(mask, (F.col("ox") == F.col("kx")) & (F.col("oy") == F.col("ky")), "left").withColumn("hit", F.col("kx").isNotNull())
    w, own = Window.partitionBy("path").orderBy("key"), Window.partitionBy("path", "hit").orderBy("key")
    t = t.withColumns({"run": F.row_number().over(w) - F.row_number().over(own), "px": F.lag("x").over(w), "py": F.lag("y").over(w), "before": F.lag("hit").over(w)}).where("hit")
    step = F.when(F.col("before"), F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))).otherwise(0.0)
    runs = t.groupBy("path", "run").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"), F.floor(F.sum(step) * 1000 + 0.5).alias("long_e3")).where("n > 1")
    best = runs.groupBy("path").agg(F.min(F.struct((-F.col("long_e3")).alias("o"), "first", "n", "long_e3")).alias("b"))
    return best.select("path", "b.first", "b.n", "b.long_e3")


@query("grid_to_place", prelude("P") + " SELECT key, CAST(floor((lng + 73.5) / 0.5 * 103) AS BIGINT) AS gx, CAST(floor((41.5 - lat) / 0.5 * 103) AS BIGINT) AS gy, CAST(floor((-73.5 + floor((lng + 73.5) / 0.5 * 103) / 103 * 0.5) * 1e6) AS BIGINT) AS lng_e6 FROM P")
def grid_to_place(spark, sf):
    """Cells of a grid, row 0 in the north, and back to degrees."""
    gx = F.floor((F.col("lng") + 73.5) / 0.5 * 103)
    return view(spark, sf, "P").select("key", gx.alias("gx"), F.floor((41.5 - F.col("lat")) / 0.5 * 103).alias("gy"), F.floor((-73.5 + gx / 103 * 0.5) * 1e6).alias("lng_e6"))


@query("sample_slices", prelude("L") + f", {_GRID}, N AS (SELECT key, px, v, row_number() OVER (PARTITION BY key % 64 ORDER BY key, px) - 1 AS nth FROM G) SELECT CAST(key % 64 AS BIGINT) AS batch, CAST(floor(nth / 9) AS BIGINT) AS place, count(*) AS n, CAST(max(v) - min(v) AS BIGINT) AS relief FROM N GROUP BY 1, 2")
def sample_slices(spark, sf):
    """Answers in the order of the questions: nine samples after each other are a place's."""
    n = _grid(spark, sf).withColumn("batch", F.col("key") % 64)
    n = n.withColumn("at", F.row_number().over(Window.partitionBy("batch").orderBy("key", "px")) - 1)
    return n.groupBy(F.col("batch").cast("long").alias("batch"), F.floor(F.col("at") / 9).alias("place")).agg(F.count(F.lit(1)).alias("n"), (F.max("v") - F.min("v")).cast("long").alias("relief"))


@query("trees_a_cell", prelude("P") + ", T AS (SELECT key, CASE key % 5 WHEN 0 THEN 22.0 WHEN 1 THEN 34.0 WHEN 2 THEN 70.0 WHEN 3 THEN 40.0 ELSE 18.0 END AS space, 4 + key % 90 AS wide FROM P) SELECT key, CAST(floor(least(1.0, (wide / CAST(space AS DOUBLE)) * (wide / CAST(space AS DOUBLE))) * 1000000) AS BIGINT) AS p_e6 FROM T")
def trees_a_cell(spark, sf):
    """How likely a cell holds a tree, by the ground's cover or, under a mask of crowns, by one spacing for all."""
    space = F.element_at(F.array(*[F.lit(v) for v in (22.0, 34.0, 70.0, 40.0, 18.0)]), (F.col("key") % 5 + 1).cast("int"))
    share = (4 + F.col("key") % 90) / space
    return view(spark, sf, "P").select("key", F.floor(F.least(F.lit(1.0), share * share) * 1000000).alias("p_e6"))


@query("made_up_heights", "WITH G AS (SELECT gx, gy FROM (SELECT unnest(range(48)) AS gx), (SELECT unnest(range(48)) AS gy)) SELECT gx, gy, CAST(floor((120 + 15 * (sin(gx / 12.0::DOUBLE * 1.7 + 1) * cos(gy / 12.0::DOUBLE * 1.3) + 0.5 * sin(gx / 12.0::DOUBLE * 3.1) * sin(gy / 12.0::DOUBLE * 2.3))) * 1000) AS BIGINT) AS mm FROM G")
def made_up_heights(spark, sf):
    """Hills for a place without samples: the same for each run."""
    g = spark.range(48 * 48).select((F.col("id") % 48).alias("gx"), F.floor(F.col("id") / 48).alias("gy"))
    u, v = F.col("gx") / 12.0, F.col("gy") / 12.0
    return g.select("gx", "gy", F.floor((120 + 15 * (F.sin(u * 1.7 + 1) * F.cos(v * 1.3) + 0.5 * F.sin(u * 3.1) * F.sin(v * 2.3))) * 1000).alias("mm"))


@query("legacy_windows", prelude("P", "R") + " SELECT p.key, count(*) AS n FROM P p JOIN R r ON abs(floor(p.lat / CAST(0.01 AS DOUBLE) + 0.5) - floor(r.lat / CAST(0.01 AS DOUBLE) + 0.5)) <= 1 AND abs(floor(p.lng / CAST(0.01 AS DOUBLE) + 0.5) - floor(r.lng / CAST(0.01 AS DOUBLE) + 0.5)) <= 1 GROUP BY p.key")
def legacy_windows(spark, sf):
    """What an older window of three by three rounded cells meets, whatever the distance."""
    at = lambda c: F.floor(F.col(c) / F.lit(0.01) + 0.5)
    ways = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    p = view(spark, sf, "P").select("key", at("lat").alias("i"), at("lng").alias("j"), F.explode(ways).alias("w")).select("key", (F.col("i") + F.col("w.a")).alias("i"), (F.col("j") + F.col("w.b")).alias("j"))
    r = view(spark, sf, "R").select(at("lat").alias("ri"), at("lng").alias("rj"))
    return p.join(r, (F.col("i") == F.col("ri")) & (F.col("j") == F.col("rj"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("trail_lengths", prelude("L") + ", C AS (SELECT key, px, sum(v) OVER (PARTITION BY key ORDER BY px) AS c, part, stat FROM L) SELECT key % 100 AS place, CAST(sum(c) AS BIGINT) AS cells, bool_or(stat = 'F') AS parking FROM (SELECT key, max(c) AS c, max(stat) AS stat FROM C GROUP BY key) GROUP BY 1")
def trail_lengths(spark, sf):
    """All runs' last sums along the way, and whether any has parking."""
    l = view(spark, sf, "L").groupBy("key").agg(F.sum("v").alias("c"), F.max("stat").alias("stat"))  # noqa: E741  the last sum is the whole sum
    return l.groupBy((F.col("key") % 100).alias("place")).agg(F.sum("c").cast("long").alias("cells"), F.bool_or(F.col("stat") == "F").alias("parking"))


@query("later_wins", prelude("C", "P") + ", U AS (SELECT key % 500 AS tile, 1 AS stage, name, key FROM P UNION ALL SELECT key % 500, 2, name, key FROM C) SELECT tile, stage, name FROM U QUALIFY row_number() OVER (PARTITION BY tile ORDER BY stage DESC, key DESC) = 1")
def later_wins(spark, sf):
    """Two stages of tiles: of each tile the last one made."""
    one = lambda role, n: view(spark, sf, role).select((F.col("key") % 500).alias("tile"), F.lit(n).alias("stage"), "name", "key")
    return one("P", 1).unionByName(one("C", 2)).groupBy("tile").agg(F.max_by(F.struct("stage", "name"), F.struct("stage", "key")).alias("t")).select("tile", "t.stage", "t.name")


@query("rings_in_box", prelude("M") + " SELECT id, CAST(5 AS BIGINT) AS corners, (x0 BETWEEN -73.42 AND -73.08) OR (x1 BETWEEN -73.42 AND -73.08) AS inside FROM M")
def rings_in_box(spark, sf):
    """Rings of four corners or more, and whether any lies in a box."""
    m = towns(spark, sf).where(F.size("ring") >= 4)
    return m.select("id", F.size("ring").cast("long").alias("corners"), F.exists("ring", lambda v: v["x"].between(-73.42, -73.08)).alias("inside"))
