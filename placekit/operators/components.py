"""Connected components by contracting stars; lineage is cut with reliable checkpoints."""

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    A local session that names none gets a folder of its own; on a cluster that is an error, as executors share no temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) -> node, label: the least node joined to it, for every node of an edge.

    Every node points its larger neighbours at its least one, then its smaller ones (Kiveris et al., 2014), until a
    round leaves all edges as they are. Minima meet map-side; a hub's edges meet its minimum in a join, which adaptive execution
    parts where they are many.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        turned = large.join(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        up, across = turned.select("a", F.col("m").alias("b")), turned.select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(up.unionByName(across).where("a != b").distinct())
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
