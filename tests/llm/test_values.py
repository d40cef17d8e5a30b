"""Values against plain versions: shards, mixture, scores, media, blocks of vectors, a dense group, hard rows."""

import collections
import hashlib
import io
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placekit.llm import exact_top_k, media_columns, ngram_jaccard_join, quality_classifier, queries, secret_scans, sharding, source_mixing, suffix_array_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_shards_by_plain_jumps(spark, docs):
    """Sizes and checksums of the texts; shards by the jump hash of the key, one number at a time."""

    def jump(key: int, shards: int) -> int:
        key, at, ahead = key % (1 << 64), -1, 0
        while ahead < shards:
            at = ahead
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return at

    keys = {r.doc_id: r.h for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    text = dict(zip(docs.doc_id, docs.text.fillna("")))
    got = queries.QUERIES["op2_sharding"](spark, SF).collect()
    for r in got:
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(b) + 16, zlib.crc32(b), jump(keys[r.doc_id], 40), jump(keys[r.doc_id], 41))
    assert len(got) == len(docs)


def test_mixture_by_a_plain_solver(spark):
    """Multipliers by halving; copies near the rates; every run alike."""
    run = lambda: sorted(tuple(r) for r in queries.QUERIES["op5_source_mixing"](spark, SF).select("doc_id", "source", "size", "target", "taken", "copies").collect())
    rows = run()
    assert rows == run()
    by_source = {}
    for _, source, size, target, _, copies in rows:
        by_source.setdefault(source, []).append((size, target, copies))
    for got in by_source.values():
        size, target, copies = (np.array(x, float) for x in zip(*got))
        goal, scale = target[0], size.sum() / max(len(size), 1)
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            rate = np.minimum(3.0, np.exp(np.minimum(mid * size / max(scale, 1e-9), 5)))
            low, high = (mid, high) if (rate * size).sum() < goal else (low, mid)
        if 0 < goal < 3 * size.sum() * (1 - 1e-9):
            assert abs((rate * size).sum() - goal) < 1e-6 * goal
        # copies of a size differ by one at most, and all in all follow the rates
        for z in set(size[size > 0]):
            c = copies[size == z]
            assert c.max() - c.min() <= 1
        assert abs((copies * size).sum() - goal) <= max(size.max(), 1) and copies.max() <= 3
        assert abs((copies - rate)[size > 0]).max() < 1.01 + size.max() / size[size > 0].min() * 0.5


def test_quality_is_the_size_difference_alone():
    good, bad = quality_classifier._coder(b"the quick brown fox " * 500), quality_classifier._coder(b"zzyq vvkx jjwq " * 500)
    x = quality_classifier.features(good, bad, [b"the quick brown fox jumps " * 20, b"zzyq vvkx jjwq qq " * 20, b""])
    assert x.shape == (3, 2) and x[0, 1] > 0 > x[1, 1] and x[2, 1] == 0
    t = b"some text of no kind"
    assert math.isclose(quality_classifier.features(good, bad, [t])[0, 1], 100 * (len(bad.compress(t)) - len(good.compress(t))) / len(t))


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 20_000)
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    rows = quality_classifier.training_rows(read("documents"), read("labels")).collect()
    for x in (0, 1):
        assert 0 < sum(len(r.text.encode()) for r in rows if r.quality == x) <= 20_000
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_quality_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    r = queries.QUERIES["op6_quality_classifier"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    r = r[r.held_out]
    good, bad = r[r.quality == 1].score.to_numpy(), r[r.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (r.predicted == r.quality).mean() > 0.95


BAD_MEDIA = [b"P2 1 1 255\n99999999999999999999", b"P2 1 1 255\n300", b"P2 1 1 255\n-4", b"P3 1 1 9\n1 2 10", b"P5 1 1 9\n\xff", b"P1 2 1 1 7", b"P5 99999999999 99999999999 255\n0", b"BM" + b"\xff" * 60, b"BM" + bytes(60), b"", b"P9", b"P6 2 2 255\nabc"]


def test_media_that_are_no_media(spark):
    d = spark.createDataFrame([(i, m) for i, m in enumerate([None, *BAD_MEDIA, b"P2 1 1 255\n255"])], "id long, media binary")
    got = sorted(media_columns.media_features(d, "media").collect())
    assert all(r.error and r.pixels is None for r in got[:-1]) and got[-1].error is None and got[-1].pixels == b"\xff"


def test_tiles_are_written(spark, tmp_path):
    px = np.arange(4096, dtype=np.uint8).reshape(64, 64)
    d = spark.createDataFrame([(1, media_columns.encode_pgm(px))], "id long, media binary")
    media_columns.write_tiles(media_columns.media_features(d, "media"), str(tmp_path / "tiles"), ["id"])
    r = spark.read.parquet(str(tmp_path / "tiles")).first()
    tile = np.load(io.BytesIO(bytes(r.tile)))
    assert tile.shape == (32, 32) and np.abs(tile - px.reshape(32, 2, 32, 2).mean((1, 3))).max() <= 1


@pytest.mark.parametrize(("block", "asked"), [(16, 4), (64, 1000)])
def test_many_blocks_of_vectors(spark, monkeypatch, block, asked):
    monkeypatch.setattr(exact_top_k, "BLOCK", block)
    monkeypatch.setattr(exact_top_k, "QUERIES", asked)
    monkeypatch.setattr(exact_top_k, "SEEDS", 8)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(tuple(r) for r in queries.QUERIES["op10_exact_top_k"](spark, SF).collect()) == sorted(c.execute(queries.ORACLE_SQL["op10_exact_top_k"]).fetchall())


def test_top_k_ties_and_large_values(spark):
    rows = [(0, [1e6, -3e6]), (3, [1e6, -3e6]), (2, [1e6, -3e6]), (5, [1e6, -3e6]), (9, [-1.0, 2.0]), (11, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = sorted(tuple(r) for r in exact_top_k.top_k(d, "vec_id", "v", F.col("vec_id") == 0, 4).collect())
    score = (256_000_000) ** 2 + 768_000_000**2
    assert got == [(0, 1, 2, score), (0, 2, 3, score), (0, 3, 5, score), (0, 4, 11, 0)]


@pytest.mark.parametrize("dense", [ngram_jaccard_join.DENSE, 300])
def test_recall_of_a_dense_group(spark, monkeypatch, dense):
    """More near copies than a leaf holds, with the values of production and in blocks: every link of similarity 0.8 or more."""
    monkeypatch.setattr(ngram_jaccard_join, "TILE", 256)
    rng = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(160)], []
    for i in range(1300):
        words = list(base)
        for at in rng.choice(160, rng.integers(0, 4), replace=False):
            words[at] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    sets = [ngram_jaccard_join.shingles(t) for _, t in rows]
    every = np.unique(np.concatenate(sets))
    seen = np.zeros((len(sets), len(every)), np.float32)
    for i, s in enumerate(sets):
        seen[i, np.searchsorted(every, s)] = 1
    shared, n = (seen @ seen.T).astype(np.int64), np.array([len(s) for s in sets])
    links = 9 * shared >= 4 * (n[:, None] + n[None, :])
    np.fill_diagonal(links, False)
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), dense=dense).collect()}
    found = sum(a for a, _ in got.values())
    assert found <= links.sum() and found >= 0.9999 * links.sum() and all(got[i][0] <= links[i].sum() for i in got)


def test_wordless_rows_stay(spark):
    rows = [(1, "\x1c\x1f"), (2, None), (3, " \u00a0\t"), (4, "a b"), (5, "A  b"), (6, "\x85")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in ngram_jaccard_join.keep_one(d).collect()} == {1, 2, 3, 4, 6}


def test_secrets_values_on_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdef1"), (3, "token=abcdef1"), (None, "x" * 100_000 + " secret: hunter22")]
    got = [(r.doc_id, r.n_assign, r.spans) for r in secret_scans.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, ""), (2, 0, ""), (3, 1, "assign:0:13"), (3, 1, "assign:0:13"), (None, 1, "assign:100001:100017")], key=str)


def test_shards_of_hard_rows(spark):
    d = spark.createDataFrame([(None, 1), (None, 1), (7, 2), (7, 2)], "k long, v long")
    got = sharding.shard_rows(d, "k", 5, ["v"], 4).collect()
    assert len({(r.k, r["shard"]) for r in got}) == 2 and all(sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in {r["shard"] for r in got})


def test_mixture_of_hard_rows(spark):
    rows = [(1, None, 5), (2, "a", 0), (3, "b", 10), (3, "b", 10), (4, "c", 0)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {(r.doc_id, r.source): (r.copies, r.target) for r in source_mixing.mix(d, "size", "source", ["doc_id"]).collect()}
    assert got[(2, "a")] == (0, 0.0) and got[(4, "c")] == (0, 0.0) and got[(3, "b")][0] + got[(1, None)][0] > 0
    assert source_mixing.mix(d.limit(0), "size", "source", ["doc_id"]).count() == 0


def test_repeats_of_hard_rows(spark):
    once = "".join(chr(97 + (i * i * 7 + i // 26) % 26) for i in range(500))
    rows = [None, "", "ab" * 99, "ab" * 101, once, once, "\u00e9" * 150, "q" + once[:200]]
    got = {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array_dedup.remove_repeats(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    of = lambda t: got[hashlib.md5(t.encode()).digest()]
    assert of("") == (0, 0, 0, b"") and of("ab" * 99)[1] == 0 and of("ab" * 101)[1:3] == (202, 1) and of("\u00e9" * 150) == (300, 300, 1, b"")
    assert of(once) == (500, 500, 1, b"") and of("q" + once[:200]) == (201, 200, 1, b"q")


def test_strings_of_one_hash_are_told_apart():
    """Hashes that say too much: bytes decide which windows repeat."""
    data = np.frombuffer(b"a" * 300 + b"b" * 250, np.uint8)
    n = len(data) - suffix_array_dedup.LENGTH + 1
    twice, fresh = suffix_array_dedup.inner_repeats(data, np.zeros(n, np.uint64))
    count, seen = {}, set()
    for i in range(n):
        count[data[i : i + 200].tobytes()] = count.get(data[i : i + 200].tobytes(), 0) + 1
    for i in range(n):
        w = data[i : i + 200].tobytes()
        assert twice[i] == (count[w] > 1) and fresh[i] == (w not in seen)
        seen.add(w)


@pytest.mark.parametrize("remembered", [1, 100_000])
def test_repeats_among_copies_in_many_partitions(spark, monkeypatch, remembered):
    """Copies are read in several tasks, and again in one: the rows are those of counting every window of every row."""
    monkeypatch.setattr(suffix_array_dedup, "SEEN", remembered)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, alone = word(260), word(900)
    rows = [alone, word(400) + passage, passage + word(50), word(500) + alone[:199], word(120), None, "", *[word(300) + passage + word(300)] * 9, *[word(700)] * 9]
    texts = [(x or "").encode() for x in rows]
    many = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    got = {bytes(r.key): bytes(r.kept) for r in suffix_array_dedup.remove_repeats(spark.createDataFrame([(t,) for t in rows], "text string").repartition(7)).collect()}
    assert len(got) == len(set(texts))
    for t in texts:
        gone = {j for i in range(len(t) - 199) if many[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert got[hashlib.md5(t).digest()] == bytes(c for j, c in enumerate(t) if j not in gone)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_equal_rows_count_once_between_batches(size):
    """Rows that agree in the anchor stay, whatever the batches, and equal rows are one."""
    import pyarrow as pa

    rows = [(b"a", 1, 5), (b"a", 1, 5), (b"a", 2, 5), (b"a", 2, 6), (b"a", 2, 6), (b"b", 2, 6), (b"b", 3, 1), (b"b", 3, 1), (b"b", 3, 1), (b"c", 4, 0), (b"d", 4, 0)]
    table = pa.table({"key": [r[0] for r in rows], "anchor": [r[1] for r in rows], "place": [r[2] for r in rows]})
    out = pa.Table.from_batches(list(suffix_array_dedup._adjacent(["anchor"])(iter(table.to_batches(max_chunksize=size)))))
    assert [tuple(r.values()) for r in out.to_pylist()] == [(b"a", 2, 5), (b"a", 2, 6), (b"b", 2, 6), (b"c", 4, 0), (b"d", 4, 0)]


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_anchors_of_many_rows_are_flagged(size):
    """More rows than the limit, in whatever batches, flag every row of the anchor; order and rows stay."""
    import pyarrow as pa

    anchors = [1] * 3 + [2] * 4 + [3] * 2 + [4] * 9 + [5] * 3 + [6] * 4
    table = pa.table({"anchor": anchors, "place": list(range(len(anchors)))})
    out = pa.Table.from_batches(list(suffix_array_dedup._flagged(3)(iter(table.to_batches(max_chunksize=size)))))
    assert out.column("place").to_pylist() == list(range(len(anchors)))
    assert out.column("large").to_pylist() == [anchors.count(a) > 3 for a in anchors]


@pytest.mark.parametrize("span", [1, 2, 7, 64, 105])
def test_leftmost_least_of_each_span(span):
    values = np.random.default_rng(span).integers(0, 6, 700).astype(np.uint64)
    want = [i + min(range(span), key=lambda j: (values[i + j], j)) for i in range(len(values) - span + 1)]
    assert suffix_array_dedup.leftmost_least(values, span).tolist() == want


def test_anchors_of_a_text_of_many_blocks():
    """Blocks of windows join without a seam: every window's anchor is its leftmost least gram."""
    data = np.random.default_rng(3).integers(97, 123, 140_000).astype(np.uint8)
    h, at, lo, hi = suffix_array_dedup.anchors(data)
    grams = suffix_array_dedup.window_hashes(suffix_array_dedup.rolling.prefixes(data), len(data), suffix_array_dedup.GRAM)
    assert lo[0] == 0 and hi[-1] == len(data) - 200 and (lo[1:] == hi[:-1] + 1).all() and (grams[at] == h).all()
    for a, first, last in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for w in {first, last}:
            assert w + int(grams[w : w + suffix_array_dedup.SPAN].argmin()) == a


def test_runs_reach_the_recall():
    assert ngram_jaccard_join.RUNS == 10
    for depth in (1, 2, 3, 7):
        for recall in (0.9, 0.999, 0.999998):
            kept = 0.8 * 0.96 ** (depth - 1)
            runs = ngram_jaccard_join.runs_for(0.8, depth, recall)
            assert (1 - kept) ** runs <= 1 - recall < (1 - kept) ** (runs - 1)
    with pytest.raises(ValueError, match="coordinates"):
        ngram_jaccard_join.runs_for(0.1, 3, 0.999999)
