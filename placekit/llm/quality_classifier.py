"""Quality by compression: zstandard dictionaries of good and of bad labelled texts.

A text is compressed with either dictionary. The difference of the sizes, over the text's length, tells which texts it
resembles; a logistic curve, fitted to labelled rows that neither dictionary saw, turns it into the probability of the label 1.
Nothing else enters a score.

The fit uses a bounded sample: of each label the rows first in the order of a hash of id and text, ``SAMPLE`` of them at most
and as many as have ``SAMPLE_BYTES`` together; texts of over ``TEXT_BYTES`` are passed over. Their sizes are looked at before a text is
moved. Scoring reads every whole text. Null and empty texts count as of no difference. If one of the labels has no row, every score is
the share of the other. Equal texts have equal scores, repeated rows each their own row; equal hashes in the sample are told apart by id.
Empty tables give empty tables. Extra columns are carried; a column of the name of the score is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import bucket_of, read_table, text_of

SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 3000, 6_000_000, 100_000
DICTIONARY, LEVEL = 1 << 20, 9
#: Of so many rows of the sample one fits the curve, the others make the dictionaries.
CURVE = 4
THRESHOLD = 0.3


@dataclass
class Model:
    """Two dictionaries and the curve: probability = 1 / (1 + exp(-features @ weights)). The first weight stands for the labels' shares."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _coder(dictionary: bytes):
    import zstandard as zstd

    d = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)


def features(good, bad, texts: list[bytes]) -> np.ndarray:
    """Columns: 1; 100 * (bad size - good size) / length."""
    saved = [100 * (len(bad.compress(t)) - len(good.compress(t))) / len(t) if t else 0.0 for t in texts]
    return np.column_stack([np.ones(len(texts)), np.array(saved, np.float64)])


def _dictionary(texts: list[bytes]) -> bytes:
    """Whole texts one after the other, the first of them last, as far as a dictionary goes."""
    return b"\n".join(reversed(texts))[-DICTIONARY:] or b"\n"


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w)


def usable() -> Column:
    """Whether the sample may hold the text."""
    return F.col("text").isNotNull() & F.octet_length("text").between(1, TEXT_BYTES)


def sample_order() -> Column:
    return F.xxhash64(F.lit(6), "doc_id", "text")


def fit(labelled: DataFrame) -> Model:
    """(doc_id, text, quality), bounded as ``training_rows`` gives them -> Model. One row of ``CURVE`` fits the curve, the others make the dictionaries."""
    rows = labelled.withColumn("__h", sample_order()).orderBy("__h", "doc_id", "text").select("text", "quality").collect()
    sample = {x: [r["text"].encode() for r in rows if r["quality"] == x] for x in (0, 1)}
    if not sample[0] or not sample[1]:
        return Model(b"\n", b"\n", (30.0 if sample[1] else -30.0 if sample[0] else 0.0, 0.0))
    good, bad = (_dictionary([t for i, t in enumerate(sample[x]) if i % CURVE] or sample[x]) for x in (1, 0))
    rest = {x: sample[x][::CURVE] for x in (0, 1)}
    x = features(_coder(good), _coder(bad), rest[1] + rest[0])
    return Model(good, bad, _logistic(x, np.repeat([1.0, 0.0], [len(rest[1]), len(rest[0])])))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text's label is 1."""
    if out in docs.columns:
        raise ValueError(f"column {out} is taken")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        coders = _coder(m.good), _coder(m.bad)
        for b in batches:
            at = b.schema.get_field_index(text)
            texts = [x.as_py() or b"" for x in b.column(at).cast(pa.binary())]
            x = features(*coders, texts)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{out}` double")


def held_out(column: Column, folds: int = 5, fold: int = 0) -> Column:
    return bucket_of(column, folds) == fold


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the sample, outside the held-out fold: doc_id, text, quality.

    They are found by their hashes and sizes; texts of others are never moved. Broadcast are ``SAMPLE`` ids of each label at most.
    """
    spark = docs.sparkSession
    seen = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), "quality")
    fit_rows = docs.where(usable()).select("doc_id", "text", sample_order().alias("__h"))
    slim = fit_rows.select("doc_id", "__h", F.octet_length("text").alias("__size")).join(seen, F.col("doc_id") == F.col("__id")).select("__id", "__h", "__size", "quality")
    picked = []
    for x in (0, 1):
        rows, size = slim.where(F.col("quality") == x).orderBy("__h", "__id").limit(SAMPLE).collect(), 0
        for r in rows:
            size += r["__size"]
            if size > SAMPLE_BYTES:
                break
            picked.append((r["__id"], r["__h"], x))
    wanted = F.broadcast(spark.createDataFrame(sorted(set(picked)), "__id long, __first long, quality int"))
    return fit_rows.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__first"))).select("doc_id", "text", "quality")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, read_table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
