"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placekit.operators.components import connected_components, materialize

__all__ = ["bucket_of", "connected_components", "materialize", "read_table", "salted_rank", "text_key", "text_of", "whole_groups"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16 bytes that stand for a text: equal texts, equal keys."""
    return F.unhex(F.md5(text_of(column).cast("binary")))


def salted_rank(df: DataFrame, group: list[str], order: list, salt: Column, salts: int, out: str) -> DataFrame:
    """Gapless 0-based rank of every row in its group, without a task that holds a group.

    A group is dealt over ``salts`` parts by ``salt`` (any hash of what tells rows apart). A row's
    rank is its rank in its part plus the rows in the parts before. The second input is one count
    for each group and part. Rows that agree in ``order`` get either rank.
    """
    part = "__part"
    rows = df.withColumn(part, F.pmod(salt, F.lit(salts)).cast("int"))
    counts = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(part).alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1)
    on = F.col(part) == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return ranked.join(starts, on).withColumn(out, (F.col("__start") + F.col("__r")).cast("long")).drop("__p", part, "__r", "__start", *[f"__g{i}" for i in range(len(group))])


def bucket_of(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def whole_groups(batches, column: str):
    """Groups of rows of equal ``column`` as dicts of lists, from batches of sorted rows.

    A group may span batches; one group at a time is held.
    """
    held: dict[str, list] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        values = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
        keys = values[column]
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(starts, starts[1:]):
            part = {n: v[lo:hi] for n, v in values.items()}
            if held is not None and held[column][0] == keys[lo]:
                for n in held:
                    held[n] += part[n]
                continue
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held
