"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles. Each set is embedded as 64 minimum hashes. A run starts from
one sampled coordinate: sets with the same token there share a node. A node with more than ``LEAF``
sets is split again: two coordinates are sampled by the node's number, and a set goes to the child of
its token in each. Small nodes are leaves, in which all pairs are compared. Runs repeat: a pair of similarity s
shares a leaf of a run with probability s times (1 - (1 - s)^2) for each further level: at 0.8 a run keeps 0.8 without a
split and 0.74 at full depth. There are as many runs as reach the recall ``RECALL`` at full depth: ten, which miss one pair in 600,000,
or one in ten million without a split. Levels are few, as
a set is in two children: what three don't split is alike indeed, and is compared in blocks.

Two steps compare: embeddings first tell which members of a leaf have a likely partner; the whole
shingle sets of those are then intersected, so every link that is counted is exact. A pair is counted
in the least leaf that it shares, and pairs are never written: a leaf returns its members' counts and
one edge for each member that is joined. Connected classes follow from these edges.

Words are what is between white space, in lower case. A text of one to four words is one shingle.
Null texts and texts without a word link to nothing and are a class of their own. Equal texts are
compared once, and count as linked. Repeated rows each get a row; of equal ids in a class one row is kept. A null id is an id like any other, before all others. Long texts
are compared whole. An empty table gives an empty table. Columns other than id and text are carried and never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm import rolling
from placekit.llm.common import connected_components, materialize, read_table, text_key, whole_groups

WORDS, SIMILARITY = 5, 0.8
COORDINATES, LEAF, DEPTH = 64, 1000, 3
RECALL = 0.999998
#: Sets of a node that doesn't split which one task compares with each other, or with as many more; rows of a matrix in hand.
DENSE, TILE = 8192, 256
#: Agreeing coordinates from which a pair is looked at: 5 standard deviations below those of SIMILARITY.
LIKELY = int(COORDINATES * (SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5))


def runs_for(similarity: float = SIMILARITY, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair of the similarity shares a leaf of ``depth`` levels with the probability ``recall``."""
    kept = similarity * (1 - (1 - similarity) ** 2) ** (depth - 1)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - kept)) if kept < 1 else 1
    if runs > COORDINATES:
        raise ValueError(f"{runs} runs need more than {COORDINATES} coordinates")
    return runs


RUNS = runs_for()
_RNG = np.random.default_rng(3)
_FACTORS = (_RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of a shorter text, of all its words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    n = max(1, len(start) - words + 1)
    return np.unique(rolling.ranges(rolling.prefixes(data), start[:n], end[-n:]))


def embed(hashes: np.ndarray) -> bytes:
    """The least of each of 64 hash functions over the set, 32 bits each."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        least = np.minimum(least, (x[lo : lo + 4096, None] * _FACTORS + _SHIFTS).min(0))
    return least.tobytes()


def _embedded(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) -> doc_id, key, n (shingles), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([embed(s) for s in sets], pa.binary())], names=["doc_id", "key", "n", "sig"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, n long, sig binary")


def _leaves(texts: DataFrame, runs: int, leaf: int, depth: int) -> DataFrame:
    """(key, sig) -> leaf, key, size for every leaf of two sets or more."""
    token = lambda at: F.substring(F.col("sig"), at * 4 + 1, F.lit(4))
    roots = F.array(*[F.xxhash64(F.lit(r), token(F.lit(r * 37 % COORDINATES))) for r in range(runs)])
    nodes = texts.select("key", "sig", F.explode(roots).alias("node"))
    found = []
    for level in range(depth):
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("node", "__node")
        shared = materialize(nodes.select("key", "node").join(sizes, F.col("node") == F.col("__node")).select("key", "node", "size"))
        last = level == depth - 1
        found.append(shared if last else shared.where(F.col("size") <= leaf))
        large = shared.where(F.col("size") > leaf)
        if last or not large.limit(1).count():
            break
        at = [F.pmod(F.xxhash64(F.lit(j), "node"), F.lit(COORDINATES)).cast("int") for j in range(2)]
        # two samples of the same coordinate give one child
        children = F.array_distinct(F.array(*[F.xxhash64(F.col("node"), a, token(a)) for a in at]))
        nodes = large.join(texts.select(F.col("key").alias("__key"), "sig"), F.col("key") == F.col("__key")).select("key", "sig", F.explode(children).alias("node"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("node").alias("leaf"), "key", "size")


def _tasks(members: DataFrame, dense: int) -> DataFrame:
    """One row of a member for each task of its leaf: only a leaf of more than ``dense`` sets is compared in pairs of blocks."""
    blocks = F.ceil(F.col("size") / F.lit(dense)).cast("int")
    own = F.pmod(F.xxhash64("leaf", "key"), blocks).cast("int")
    m = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return m.withColumn("task", F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other"))).withColumn("cross", F.col("own") != F.col("other"))


def _sides(task: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """The members that are compared with each other: all with all, or those of one block with those of the other."""
    every = np.arange(len(task["key"]))
    if not task["cross"][0]:
        return every, every
    own = np.asarray(task["own"])
    return every[own == own.min()], every[own != own.min()]


def _tiles(n: int):
    return (slice(lo, min(lo + TILE, n)) for lo in range(0, n, TILE))


def _allowed(task: dict[str, list], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ``a`` and ``b`` that this task counts: those of no lesser leaf in common."""
    leaf, n = task["leaf"][0], len(task["key"])
    who = np.repeat(np.arange(n), [len(x) for x in task["leaves"]])
    less = np.concatenate([np.asarray(x, np.int64) for x in task["leaves"]])
    who, less = who[less < leaf], less[less < leaf]
    _, at, many = np.unique(less, return_inverse=True, return_counts=True)
    both = many[at] > 1
    cols, at = np.unique(at[both], return_inverse=True)
    order = np.argsort(at, kind="stable")
    who, at = who[both][order], at[order]
    ok = np.ones((len(a), len(b)), bool)
    for lo in range(0, len(cols), TILE):  # lesser leaves some at a time: they may be many
        i, j = np.searchsorted(at, [lo, lo + TILE])
        seen = np.zeros((n, TILE), np.float32)
        seen[who[i:j], at[i:j] - lo] = 1
        left, right = seen[a], seen[b].T
        for t in _tiles(len(a)):
            ok[t] &= (left[t] @ right) == 0
    if a is b:
        np.fill_diagonal(ok, False)
    return ok


def _likely(task: dict[str, list]) -> np.ndarray:
    """Members with a likely partner that this task counts."""
    sig, out = np.frombuffer(b"".join(task["sig"]), np.uint32).reshape(-1, COORDINATES), np.zeros(len(task["sig"]), bool)
    a, b = _sides(task)
    if not len(b):
        return out
    ok, there = _allowed(task, a, b), sig[b]
    for i in range(len(a)):
        first = i + 1 if a is b else 0
        some = ok[i, first:]
        if some.sum() * 2 > len(some):
            hit = np.flatnonzero(((there[first:] == sig[a[i]]).sum(1) >= LIKELY) & some) + first
        else:
            at = np.flatnonzero(some) + first
            hit = at[(there[at] == sig[a[i]]).sum(1) >= LIKELY]
        if len(hit):
            out[a[i]] = True
            out[b[hit]] = True
    return out


def _links(task: dict[str, list], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ``a`` and ``b`` of similarity 0.8 or more that this task counts, from the whole sets."""
    sets = [np.frombuffer(s, np.uint64) for s in task["set"]]
    n = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), n)
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = many[at] > 1  # a shingle of one set alone is in no intersection
    column = np.cumsum(many > 1) - 1
    who, at = who[both], column[at[both]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    top, ok = int(at[-1]) + 1 if len(at) else 0, _allowed(task, a, b)
    for t in _tiles(len(a)):
        rows = np.flatnonzero(ok[t].any(1)) + t.start
        shared = np.zeros((len(rows), len(b)), np.float32)
        for lo in range(0, top if len(rows) else 0, TILE):
            i, j = np.searchsorted(at, [lo, lo + TILE])
            x = np.zeros((len(sets), TILE), np.float32)
            x[who[i:j], at[i:j] - lo] = 1
            shared += x[a[rows]] @ x[b].T
        # shared / union >= 4 / 5 in whole numbers
        ok[rows] &= 9 * shared.astype(np.int32) >= 4 * (n[a[rows]][:, None] + n[b][None, :])
    return ok


def _joined(task: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """For each member: the documents it is linked to by this task, and the least member joined to it."""
    a, b = _sides(task)
    copies, n = np.asarray(task["copies"], np.int64), len(task["key"])
    counts, label = np.zeros(n, np.int64), np.arange(n, dtype=np.int32)
    if not len(b):
        return counts, label
    links = _links(task, a, b)
    for t in _tiles(len(a)):
        counts[a[t]] += (links[t] * copies[b][None, :]).sum(1)
        if a is not b:
            counts[b] += (links[t] * copies[a[t]][:, None]).sum(0)
    while True:
        new = label.copy()
        for t in _tiles(len(a)):
            new[a[t]] = np.minimum(new[a[t]], np.where(links[t], label[b][None, :], n).min(1))
            if a is not b:
                new[b] = np.minimum(new[b], np.where(links[t], label[a[t]][:, None], n).min(0))
        new = new[new]
        if (new == label).all():
            return counts, label
        label = new


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """key, set for the needed texts."""
    needed = needed.select(F.col("key").alias("__key")).distinct()
    texts = docs.select("key", "text").join(needed, F.col("key") == F.col("__key"), "left_semi").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py() or "").tobytes() for x in b.column(1)], pa.binary())], names=["key", "set"])

    return texts.mapInArrow(run, "key binary, set binary")


def jaccard_join(docs: DataFrame, runs: int = RUNS, leaf: int = LEAF, depth: int = DEPTH, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all rows, and for each key: its class (rep_id and rep_key), copies and near (documents of other texts linked to it).

    docs: doc_id, text. The representative of a class is its least (doc_id, key).
    """
    docs = docs.select("doc_id", text_key().alias("key"), "text")
    rows = materialize(_embedded(docs))
    texts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "key")).alias("first"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    texts = materialize(texts.where("n > 0"))
    members = materialize(_leaves(texts.select("key", "sig"), runs, leaf, depth))
    lists = members.groupBy("key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    lists = texts.select(F.col("key").alias("__key"), "sig", "copies").join(lists.withColumnRenamed("key", "__k"), F.col("__key") == F.col("__k")).drop("__k")
    tasks = _tasks(members, dense).join(lists, F.col("key") == F.col("__key"))
    tasks = tasks.select("task", "leaf", "key", "own", "cross", "leaves", "copies", "sig").repartition("task").sortWithinPartitions("task")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in whole_groups(batches, "task"):
            if len(task["key"]) > 1:
                keep = np.flatnonzero(_likely(task))
                yield pa.RecordBatch.from_arrays([pa.array([task[c][i] for i in keep], t) for c, t in (("task", pa.int64()), ("leaf", pa.int64()), ("key", pa.binary()), ("own", pa.int32()), ("cross", pa.bool_()), ("leaves", pa.list_(pa.int64())), ("copies", pa.int64()))], names=["task", "leaf", "key", "own", "cross", "leaves", "copies"])

    near = materialize(tasks.mapInArrow(likely, "task long, leaf long, key binary, own int, cross boolean, leaves array<long>, copies long"))
    sets = _sets(docs, near).withColumnRenamed("key", "__key")
    whole = near.join(sets, F.col("key") == F.col("__key")).drop("__key").repartition("task").sortWithinPartitions("task")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in whole_groups(batches, "task"):
            counts, label = _joined(task)
            keep = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([task["key"][i] for i in keep], pa.binary()), pa.array([task["key"][label[i]] for i in keep], pa.binary()), pa.array(counts[keep], pa.int64())], names=["key", "root", "near"])

    found = materialize(whole.mapInArrow(linked, "key binary, root binary, near long"))
    labels = connected_components(found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("near").alias("near")).withColumnRenamed("key", "__c")
    by_key = texts.select("key", "copies", "first").join(labels.withColumnRenamed("node", "__n"), F.col("key") == F.col("__n"), "left").join(counts, F.col("key") == F.col("__c"), "left")
    by_key = by_key.select("key", "copies", "first", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("label", "key").alias("label"))
    reps = by_key.groupBy("label").agg(F.min("first").alias("rep")).withColumnRenamed("label", "__l")
    by_key = by_key.join(reps, F.col("label") == F.col("__l")).select("key", "copies", "near", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
    return rows.select("doc_id", "key"), by_key


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the least id of its class), n_links (other documents of similarity 0.8 or more)."""
    rows, by_key = jaccard_join(docs, **how)
    out = rows.join(by_key.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"), "left")
    alone = F.col("copies").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("near") + F.col("copies") - 1).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that represent their class; rows without a word all stay."""
    _, by_key = jaccard_join(docs.select("doc_id", "text"), **how)
    reps = by_key.where("key = rep_key").select(F.col("rep_key").alias("__key"), F.col("rep_id").alias("__id"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")  # what Python's split leaves no word of
    some = docs.where(~wordless).withColumn("__k", text_key())
    kept = some.join(reps, (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).dropDuplicates(["__k", "__id"])
    return kept.select(*docs.columns).unionByName(docs.where(wordless))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
