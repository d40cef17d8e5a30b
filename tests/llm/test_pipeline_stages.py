"""Each stage of the pipeline against a plain version, on the rows that it gets."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from placekit.llm import best_fit_packing, quality_classifier, secret_scans, source_mixing

SF = "/root/testdata/sf0.001"
HARD = [(1, None, None, None, None), (2, "", None, "a", 0), (2, "", None, "a", 0), (None, "token=abcdef123456 and more", None, None, 3), (5, "x y " * 9000, "en", "b", 9), (5, "x y " * 9000, "en", "b", 9), (6, " \n\t ", "en", "b", 2), (7, "z" * 5000, "en", "b", 2)]


@pytest.fixture(scope="module", params=["table", "hard"])
def docs(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    return spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")


def bag(rows):
    return collections.Counter(tuple(r[c] for c in cp.COLUMNS) for r in rows)


def test_quality(spark, docs):
    model = quality_classifier.fit(quality_classifier.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    good, bad = quality_classifier._coder(model.good), quality_classifier._coder(model.bad)
    want = collections.Counter()
    for r in docs.collect():
        t = (r.text or "").encode()
        saved = 100 * (len(bad.compress(t)) - len(good.compress(t))) / len(t) if t else 0.0
        if 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * saved, -30, 30))) >= 0.3:
            want[tuple(r[c] for c in cp.COLUMNS)] += 1
    assert bag(cp.quality(spark, docs, SF).collect()) == want


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    words = [(r.text or "").lower().split() for r in rows]
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) or ({tuple(w)} if w else set()) for w in words]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    order = lambda r: (r.doc_id is not None, r.doc_id or 0)
    best = {}
    for i, r in enumerate(rows):
        if sets[i] and (root(i) not in best or order(r) < order(best[root(i)])):
            best[root(i)] = r
    want = collections.Counter(r.doc_id for r in best.values()) + collections.Counter(r.doc_id for i, r in enumerate(rows) if not sets[i])
    got = cp.near_duplicates(spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == want and not bag(got) - bag(rows)


def test_secrets(spark, docs):
    spans = {(r.doc_id, r.n_assign, r.spans) for r in secret_scans.report(docs.select("doc_id", "text")).collect()}
    by_id = collections.defaultdict(set)
    for i, _, s in spans:
        by_id[i].add(s)
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in cp.secrets(spark, docs, SF).collect())
    want = collections.Counter()
    for r in docs.collect():
        if r.text is None:
            want[(r.doc_id, None, r.n_chars)] += 1
            continue
        (told,) = by_id[r.doc_id]
        hidden = np.zeros(len(r.text) + 1, np.int64)
        for s in filter(None, told.split(",")):
            _, a, b = s.split(":")
            hidden[int(a)] += 1
            hidden[int(b)] -= 1
        cover = np.cumsum(hidden[:-1]) > 0
        # touching spans each have a mark of their own
        starts = {int(s.split(":")[1]) for s in filter(None, told.split(","))}
        text = "".join("" if cover[i] and not (i in starts and hidden[:i].sum() == 0) else "[SECRET]" if cover[i] else c for i, c in enumerate(r.text))
        want[(r.doc_id, text, len(text))] += 1
    assert got == want


def test_mixture(spark, docs):
    slim = docs.select("doc_id", "source", source_mixing.word_count().alias("size"), F.xxhash64("text").alias("text_hash"), F.xxhash64(*cp.COLUMNS).alias("row_hash"))
    mixed = source_mixing.mix(slim, "size", "source", ["doc_id", "text_hash", "row_hash"])
    copies = collections.Counter()
    for r in mixed.collect():
        copies[(r.doc_id, r.row_hash)] += r.copies
    hashes = {(r.doc_id, r.h): tuple(r[c] for c in cp.COLUMNS) for r in docs.withColumn("h", F.xxhash64(*cp.COLUMNS)).collect()}
    want = collections.Counter({hashes[k]: n for k, n in copies.items() if n})
    assert bag(cp.mixture(spark, docs, SF).collect()) == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(best_fit_packing.default_tokenizer())
    want = collections.Counter()
    for r in docs.collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want[(r.doc_id, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    got = cp.packing(spark, docs, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    room = collections.defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, cp.run(spark, SF).collect())) == sorted(map(key, docs.collect()))
