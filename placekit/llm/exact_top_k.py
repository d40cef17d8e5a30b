"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (norm) into buckets, and dealt into blocks of bounded size inside a
bucket. Queries come in blocks too, each with a lower bound of its k-th score, taken from the longest
vectors of the table. A pair of blocks in which no query can reach its bound is never formed. Inside
a pair each query has a local cosine threshold, bound / (its norm * longest norm): above 1 the block
is skipped; where it is high, the block's vectors are pruned by the coordinate in which the query is
largest; else by their length. Products of what is left are verified, and the best k of a pair of
blocks go on to a last merge.

Vectors that are null or hold a null or non-finite component take no part; vectors of another number
of components than a query's aren't its candidates. Ties go to the smaller id. Repeated ids are
candidates each for itself, but never of a query with their own id. Products must fit 53 bits;
larger ones are found with Python's integers and must fit 64 bits. Null ids take no part. An empty table gives an empty table. Columns
other than the id and the vector are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placekit.llm.common import materialize, read_table

#: Rows of a block of candidates, and of queries, at most about.
BLOCK, QUERIES = 8192, 2048
#: Parts over which the pairs of blocks are found.
SALTS = 32
#: Longest vectors that give the first bounds. They are broadcast: this many at most.
SEEDS = 2048
#: Local cosine from which coordinates prune better than lengths.
STEEP = 0.6
#: Buckets for each doubling of the norm.
FINE = 4


def quantized(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where a component is null or not finite."""
    v = F.col(column)
    x = lambda e: e.cast("double")
    good = F.forall(v, lambda e: F.coalesce((x(e) < float("inf")) & (x(e) > float("-inf")) & ~F.isnan(x(e)), F.lit(False)))
    return F.when(v.isNotNull() & good, F.transform(v, lambda e: F.floor(x(e) * scale).cast("long")))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.int64) for x in column])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in doubles while every sum is below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids, q, bounds, c_ids, c, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the best k of a block for each query, but none below its bound."""
    out = []
    norms = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    c, c_ids, norms = c[order], c_ids[order], norms[order]
    longest, lengths = norms[0], np.sqrt((q.astype(np.float64) ** 2).sum(1))
    fit = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * c.shape[1] < 2**53
    wide = c.astype(np.float64) if fit else c.astype(object)
    unit = c / np.maximum(norms, 1e-300)[:, None]
    by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    slack = 1e-9
    for i in range(len(q_ids)):
        bound, own, keep = bounds[i], lengths[i], slice(None)
        if bound > 0:  # else nothing can be pruned
            if own == 0 or (cos := bound / (own * longest) if longest else 2.0) > 1 + slack:
                continue
            if cos >= STEEP:
                f = int(np.abs(q[i]).argmax())
                if f not in by_coordinate:
                    at = np.argsort(unit[:, f], kind="stable")
                    by_coordinate[f] = (at, unit[at, f])
                at, values = by_coordinate[f]
                x, t = q[i, f] / own, min(cos, 1.0)
                spread = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t)))
                # cos(q, p) >= t holds only for p_f within x t -+ spread; beyond x the bound is 1
                low = x * t - spread if x > -t else -1.0
                high = x * t + spread if x < t else 1.0
                keep = at[np.searchsorted(values, low - slack) : np.searchsorted(values, high + slack, side="right")]
            else:
                keep = slice(0, int(np.searchsorted(-norms, -(bound / own) * (1 - slack), side="right")))
        score = (wide[keep] @ (q[i].astype(np.float64) if fit else q[i].astype(object))).astype(np.int64)
        ids = c_ids[keep]
        live = (ids != q_ids[i]) & (score >= bound)
        ids, score = _best(ids[live], score[live], k)
        out += [(int(q_ids[i]), int(a), int(s)) for a, s in zip(ids, score, strict=True)]
    return out


def _stored(m: np.ndarray) -> tuple[str, bytes]:
    """The narrowest whole numbers that hold the matrix."""
    top = int(np.abs(m).max(initial=0))
    kind = next(k for k, most in (("i1", 127), ("i2", 32767), ("i4", (1 << 31) - 1), ("i8", 1 << 63)) if top <= most)
    return kind, m.astype(kind).tobytes()


def _pack(kind: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["v"])
        own = np.sqrt(np.maximum(pdf["norm2"].to_numpy(float), 0))
        if kind == "q":
            bound = pdf["bound"].to_numpy(np.int64)
            extra = {"bounds": [bound.tobytes()], "reach": [float(np.where(bound > 0, bound / np.where(own > 0, own, 1.0), -1.0).min())]}
        else:
            extra = {"longest": [float(own.max())]}
        how, data = _stored(m)
        return pd.DataFrame({"dim": [m.shape[1]], "block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "how": [how], "m": [data]} | extra)

    return pack


def top_k(vectors: DataFrame, key: str, column: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query by integer inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), is_query.alias("is_query"), quantized(column, scale).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("dim", F.size("v")).where("dim > 0")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = materialize(rows.withColumn("norm2", square))
    seeds = rows.orderBy(F.col("norm2").desc(), "id").limit(SEEDS).select("id", "dim", "v").toPandas()
    by_dim = {int(d): (g["id"].to_numpy(np.int64), _matrix(g["v"])) for d, g in seeds.groupby("dim")}
    known = spark.sparkContext.broadcast(by_dim)

    @F.pandas_udf("long")
    def bound(ids: pd.Series, vs: pd.Series) -> pd.Series:
        """The k-th score among the seeds; the least long where they are fewer."""
        low, out = np.iinfo(np.int64).min, []
        for i, v in zip(ids, vs, strict=True):
            c_ids, c = known.value.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)), np.int64)))
            scores = products(np.asarray(v, np.int64)[None], c)[0][c_ids != i]
            out.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else low)
        return pd.Series(out, dtype="int64")

    def blocks(df: DataFrame, bucket: Column, size: int) -> DataFrame:
        """A number for blocks of about ``size`` rows of equal dim and bucket; the counts are one row for each bucket."""
        df = df.withColumn("bucket", bucket)
        many = df.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts"))
        many = many.select(F.col("dim").alias("d"), F.col("bucket").alias("b"), "parts")
        df = df.join(many, (F.col("dim") == F.col("d")) & (F.col("bucket") == F.col("b")))
        part = F.pmod(F.xxhash64(F.lit(11), "id", "v"), F.col("parts"))
        return df.withColumn("block", F.xxhash64("dim", "bucket", part)).drop("d", "b", "parts")

    bucket = F.when(F.col("norm2") > 0, F.floor(F.log2("norm2") / 2 * FINE)).otherwise(F.lit(-1)).cast("long")
    # queries of like bounds share a block, so that a weak one doesn't call for all blocks in the name of strong ones
    reach = F.col("bound") / F.sqrt(F.greatest("norm2", F.lit(1e-300)))
    strength = F.when(F.col("bound") > 0, F.floor(F.log2(reach) * FINE)).otherwise(F.lit(-(1 << 20))).cast("long")
    q = blocks(rows.where("is_query").withColumn("bound", bound("id", "v")), strength, QUERIES)
    q = materialize(q.groupBy("dim", "block").applyInPandas(lambda p: _pack("q")(p), "dim int, block long, ids binary, how string, m binary, bounds binary, reach double"))
    q = q.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "how": "q_how", "m": "q_m", "dim": "q_dim"})
    c = materialize(blocks(rows, bucket, BLOCK).groupBy("dim", "block").applyInPandas(lambda p: _pack("c")(p), "dim int, block long, ids binary, how string, m binary, longest double"))
    # only the blocks' numbers and norms meet by dim, dealt over parts; a pair in which no query reaches its bound isn't formed
    salt = lambda name: F.pmod(F.xxhash64(name), F.lit(SALTS))
    heads = q.select("q_dim", "q_block", "reach", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("q_salt"))
    met = c.select("dim", "block", "longest", salt("block").alias("salt")).join(heads, (F.col("dim") == F.col("q_dim")) & (F.col("salt") == F.col("q_salt")) & (F.col("longest") >= F.col("reach") * (1 - 1e-9)))
    # the smaller matrices, those of queries, go to each block that they call for; a block's own matrix moves once
    called = met.select(F.col("block").alias("c_block"), F.col("q_block").alias("called")).join(q, F.col("called") == F.col("q_block"))
    pairs = called.join(c, F.col("c_block") == F.col("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                shape = (-1, r.dim)
                q_m, c_m = (np.frombuffer(m, how).reshape(shape).astype(np.int64) for m, how in ((r.q_m, r.q_how), (r.m, r.how)))
                found = search_block(np.frombuffer(r.q_ids, np.int64), q_m, np.frombuffer(r.bounds, np.int64), np.frombuffer(r.ids, np.int64), c_m, k)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "q_ids", "q_how", "q_m", "bounds", "ids", "how", "m").mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
