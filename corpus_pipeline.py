"""Corpus pipeline: rejects poor documents, joins near duplicates, removes secrets, mixes, packs.

Every stage takes the documents that the one before kept, and returns documents; the last returns
the packed pieces. SQL can express none of the model-based stages, so ORACLE_SQL is None; each stage is
tested against a plain version.

Null ids, sources and other columns are values like any other. Null and empty texts have a score of no difference, are near duplicates of nothing,
hold no secret, have size 0 and so no copy in the mixture. Repeated rows are one class of copies, of which one stays; ties go to the lesser id. Long texts
are handled whole. An empty table gives an empty result. Columns other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekit.llm import best_fit_packing, ngram_jaccard_join, quality_classifier, secret_scans, source_mixing
from placekit.llm.common import materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labelled ones."""
    model = quality_classifier.fit(quality_classifier.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model, out="__score").where(F.col("__score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    return ngram_jaccard_join.keep_one(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scans.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    slim = docs.select("doc_id", "source", source_mixing.word_count().alias("size"), F.xxhash64("text").alias("text_hash"), F.xxhash64(*COLUMNS).alias("row_hash"))
    mixed = source_mixing.mix(materialize(slim), "size", "source", ["doc_id", "text_hash", "row_hash"])
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__row"), "copies").groupBy("__id", "__row").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    # repeated rows put their copies together: one row of them is taken that often
    rows = docs.select(*COLUMNS).withColumn("__row0", F.xxhash64(*COLUMNS)).dropDuplicates(["doc_id", "__row0"])
    taken = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row0") == F.col("__row")))
    return taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return best_fit_packing.pack_documents(docs, best_fit_packing.default_tokenizer())


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secrets), ("source_mixing", mixture), ("best_fit_packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
