"""What a map asks: filters, search, nearest, clicks, marks, pools."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from placekit.functions import geo
from placekit.operators.spatial import radius_join
from placekit.plans.adapter import prelude, view
from placekit.plans.registry import query
from placekit.plans.values import JUDGED, judged

_J = prelude("P") + f", {JUDGED}"
_SHOWN = "access <> 'closed' AND type IN ('state', 'town', 'preserve') AND contains(lower(concat_ws(' ', name, type, op)), 'o')"
HERE = (41.25, -73.25)


def shown(df):
    text = F.lower(F.concat_ws(" ", "name", "type", "op"))
    return df.where((F.col("access") != "closed") & F.col("type").isin("state", "town", "preserve") & text.contains("o"))


@query("visible_filter", f"{_J} SELECT key FROM B WHERE {_SHOWN}")
def visible_filter(spark, sf):
    return shown(judged(spark, sf)).select("key")


@query("search_top12", f"{_J}, X AS (SELECT key, name, row_number() OVER (ORDER BY key) AS rank, count(*) OVER () AS n FROM B WHERE {_SHOWN} AND contains(lower(name), 'oak')) SELECT key, name, CAST(rank AS INTEGER) AS rank, n > 12 AS more FROM X WHERE rank <= 12")
def search_top12(spark, sf):
    """The first 12 and whether there is a 13th: 13 rows at most reach the window."""
    top = shown(judged(spark, sf)).where(F.lower("name").contains("oak")).select("key", "name").orderBy("key").limit(13)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy("key"))).withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) > 12)
    return top.where("rank <= 12")


_KM = f"2 * 6371 * asin(sqrt(power(sin(radians(lat - {HERE[0]}::DOUBLE) / 2), 2) + cos(radians({HERE[0]}::DOUBLE)) * cos(radians(lat)) * power(sin(radians(lng - ({HERE[1]}::DOUBLE)) / 2), 2)))"


def near_pool(spark, sf):
    p = judged(spark, sf).where("status IN ('park', 'fee')")
    km = geo.haversine_km(F.lit(HERE[0]), F.lit(HERE[1]), F.col("lat"), F.col("lng"))
    return p.select("key", "name", F.floor(km * 1000).alias("km_e3"))


@query("near_top6", f"{_J}, X AS (SELECT key, name, CAST(floor(({_KM}) * 1000) AS BIGINT) AS km_e3 FROM B WHERE status IN ('park', 'fee')) SELECT key, name, CAST(row_number() OVER (ORDER BY km_e3, key) AS INTEGER) AS rank, km_e3 FROM X ORDER BY km_e3, key LIMIT 6")
def near_top6(spark, sf):
    top = near_pool(spark, sf).orderBy("km_e3", "key").limit(6)
    return top.select("key", "name", F.row_number().over(Window.orderBy("km_e3", "key")).alias("rank"), "km_e3")


@query("near_matrix_rerank", f"{_J}, X AS (SELECT key, CAST(floor(({_KM}) * 1000) AS BIGINT) AS km_e3 FROM B WHERE status IN ('park', 'fee')), T AS (SELECT key, row_number() OVER (ORDER BY km_e3, key) AS n FROM X ORDER BY n LIMIT 25), S AS (SELECT key, CASE WHEN n % 7 <> 0 THEN (n * 389) % 1000 END AS sec FROM T) SELECT key, CAST(sec AS BIGINT) AS sec, CAST(row_number() OVER (ORDER BY sec, key) AS INTEGER) AS rank FROM S WHERE sec IS NOT NULL ORDER BY sec, key LIMIT 6")
def near_matrix_rerank(spark, sf):
    top = near_pool(spark, sf).orderBy("km_e3", "key").limit(25).withColumn("n", F.row_number().over(Window.orderBy("km_e3", "key")))
    took = top.select("key", F.when(F.col("n") % 7 != 0, (F.col("n") * 389 % 1000).cast("long")).alias("sec")).where("sec IS NOT NULL")
    return took.orderBy("sec", "key").limit(6).select("key", "sec", F.row_number().over(Window.orderBy("sec", "key")).alias("rank"))


CLICKS = [(i, 41.02 + i * 0.037, -73.48 + i * 0.041) for i in range(10)]
_CLICK = "K AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, a, b in CLICKS) + ") k(key, lat, lng))"


@query("click_nearest", prelude("P") + f", {_CLICK}, X AS (SELECT p.key AS click, c.key, sqrt(power((c.lat - p.lat) * 111000, 2) + power((c.lng - p.lng) * 111000 * cos(radians(p.lat)), 2)) AS d FROM K p, P c) SELECT click, arg_min(key, (floor(d * 1000), key)) AS key FROM X WHERE d <= 4000 GROUP BY click")
def click_nearest(spark, sf):
    clicks = spark.createDataFrame(CLICKS, "click long, lat double, lng double").withColumn("click", F.col("click").cast("int"))
    places = view(spark, sf, "P").select(F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("key").alias("r_key"))
    pairs = radius_join(clicks, places, F.lit(4000.0), cell=0.04)
    return pairs.groupBy("click").agg(F.min_by("r_key", F.struct(F.floor(F.col("dist") * 1000), F.col("r_key"))).alias("key"))


@query("smallest_hit", prelude("P", "M") + f", {_CLICK}, H AS (SELECT K.key AS click, m.id, m.layer FROM K JOIN M m ON K.lng > m.x0 - 0.05 AND K.lng < m.x1 + 0.05 AND K.lat > m.y0 - 0.05 AND K.lat < m.y1 + 0.05) SELECT click, arg_min(id, (CASE WHEN layer = 0 THEN 1000000000 ELSE layer END, id)) AS id FROM H GROUP BY click")
def smallest_hit(spark, sf):
    """The smallest area under a click; areas without a size come last. Clicks are a handful."""
    clicks = F.broadcast(spark.createDataFrame(CLICKS, "click long, lat double, lng double").withColumn("click", F.col("click").cast("int")))
    m = view(spark, sf, "M")
    hit = m.join(clicks, F.col("lng").between(F.col("x0") - 0.05, F.col("x1") + 0.05) & F.col("lat").between(F.col("y0") - 0.05, F.col("y1") + 0.05))
    size = F.when(F.col("layer") == 0, 1000000000).otherwise(F.col("layer"))
    return hit.groupBy("click").agg(F.min_by("id", F.struct(size.alias("s"), "id")).alias("id"))


_MARK = "CASE WHEN regexp_matches(name, '(?i)beach') THEN 'beach' WHEN regexp_matches(name, '(?i)pond|lake|reservoir') THEN 'water' WHEN trails THEN 'trail' WHEN type = 'cemetery' THEN 'stone' ELSE 'dot' END"


@query("viewport_marks", prelude("P") + f"SELECT key, {_MARK} AS mark FROM P WHERE lat BETWEEN 41.1 AND 41.2 AND lng BETWEEN -73.4 AND -73.2 ORDER BY key LIMIT 260")
def viewport_marks(spark, sf):
    n = F.col("name")
    mark = F.when(n.rlike("(?i)beach"), "beach").when(n.rlike("(?i)pond|lake|reservoir"), "water").when(F.col("trails"), "trail").when(F.col("type") == "cemetery", "stone").otherwise("dot")
    return view(spark, sf, "P").where("lat BETWEEN 41.1D AND 41.2D AND lng BETWEEN -73.4D AND -73.2D").orderBy("key").limit(260).select("key", mark.alias("mark"))


@query("random_pool", f"{_J} SELECT count(*) FILTER (WHERE status = 'park' AND trails AND type IN ('state', 'town', 'preserve')) AS n_pool, count(*) FILTER (WHERE status = 'park' AND trails AND type IN ('state', 'town', 'preserve')) = 0 AS fallback FROM B")
def random_pool(spark, sf):
    ok = (F.col("status") == "park") & F.col("trails") & F.col("type").isin("state", "town", "preserve")
    return judged(spark, sf).agg(F.count_if(ok).alias("n_pool")).withColumn("fallback", F.col("n_pool") == 0)


@query("research_queue", f"{_J}, X AS (SELECT key, acres * CASE WHEN regexp_matches(name, '(?i)preserve|forest') THEN 2 ELSE 1 END AS score FROM B WHERE status = 'unverified' AND acres >= 5 AND NOT researched) SELECT key, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY score DESC, key) AS INTEGER) AS rank FROM X ORDER BY score DESC, key LIMIT 40")
def research_queue(spark, sf):
    q = judged(spark, sf).where("status = 'unverified' AND acres >= 5 AND NOT researched")
    score = (F.col("acres") * F.when(F.col("name").rlike("(?i)preserve|forest"), 2).otherwise(1)).cast("long")
    top = q.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(40)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


@query("limit_n", prelude("P") + "SELECT key FROM P ORDER BY key LIMIT 25")
def limit_n(spark, sf):
    return view(spark, sf, "P").select("key").orderBy("key").limit(25)


@query("gold_prune", f"{_J} SELECT key, CASE WHEN name <> '' THEN name END AS name, CASE WHEN trails THEN TRUE END AS trails, CAST(floor(lat * 100000 + 0.5) AS BIGINT) AS lat_e5 FROM B WHERE access <> 'closed'")
def gold_prune(spark, sf):
    p = judged(spark, sf).where("access <> 'closed'")
    return p.select("key", F.nullif("name", F.lit("")).alias("name"), F.when(F.col("trails"), True).alias("trails"), F.floor(F.col("lat") * 100000 + 0.5).alias("lat_e5"))
