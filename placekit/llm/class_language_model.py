"""Brown class-based n-grams: words in classes found by exchange, scored by class transitions and emissions.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class). Tokens are the
words (ASCII letters lowered) and one end after each text, which also stands before the first word.

Texts are read once, into blocks: the distinct words of some texts and the numbers of their words in order. Every word of
the training texts has a class found by exchange, by the class bigrams counted over the whole corpus:

* Words with at least 1 / ``HEAVY`` of the tokens (``HEAVY`` at most) are the contexts; all others together are one context more. Bigrams of
  contexts are summed in ``RANGES`` parts of the words, each with all that stands before and after its words. Starting from classes
  dealt by hash, each round moves half of the words, each to the class of the best likelihood. Rounds end when
  two in turn move words with less than ``FEW`` of the tokens, or raise the likelihood by less than 0.0001 a token.
* A rarer word is no context of its own, so the classes around it don't change any more: one more step places each such word
  where its own neighbours, counted over the whole corpus, are likeliest. Its counts meet by word, in sorted order.

Class bigrams are then counted anew over all tokens and all words. A word that training has not seen takes the class that
most words with the hash of its last three bytes have. Transitions are smoothed towards the frequency of classes; emissions by
one count for each word of the class and for one unknown word.

On every executor are at most ``HEAVY`` words with their classes. Null texts are empty: their end alone is scored. Equal texts have equal scores,
repeated rows each their own row, ties between classes go to the lower number. A long text is never parted: a block ends after a text.
An empty table gives an empty table. Columns other than the id and the text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import bucket_of, materialize, read_table

BINS, HEAVY = 1 << 10, 1 << 18
CLASSES, SMOOTH, FEW = 64, 2.0, 0.002
#: Tokens of a block, about. Parts of the heavy words. Blocks whose bigrams one task sums up, at most about.
BLOCK, RANGES, FAN = 1_500_000, 64, 1024
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, in lower case, and the end."""
    return [*text.lower().split(), END]


def bin_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BINS


@dataclass
class Model:
    """What scoring needs on every executor: sizes are bounded by BINS, HEAVY and CLASSES."""

    total: int
    distinct: int
    heavy: dict[bytes, int]  # word -> its place in the arrays
    counts: np.ndarray
    classes: np.ndarray
    unseen: np.ndarray  # class of a word that training has not seen, by bin
    room: np.ndarray  # log10 of the denominators of the emissions


class _Places(dict):
    """Words in the order in which they are first looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _zip(*arrays: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    flat = [np.array([len(a) for a in arrays], np.int64), *(a.astype(np.int64) for a in arrays)]
    return zlib.compress(b"".join([len(arrays).to_bytes(4, "little"), *(a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in flat)]), 1)


def _unzip(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    many, at = int.from_bytes(raw[:4].tobytes(), "little"), 4

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += 8 * n
        return np.ascontiguousarray(raw[at - 8 * n : at].reshape(8, n).T).view(np.int64).reshape(-1)

    return [take(int(n)) for n in take(many)]


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, text, train) -> block, n (training tokens), words, tokens, ids, train: one row for each block of texts.

    words: those of the block, after the end; tokens: their places, text after text, an end after each. Both are compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 12, 0
        at, parts, ids, train, rows, n = _Places({END: 0}), [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            stream = np.concatenate(parts)
            wide = stream.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            row = {"block": pa.array([first + made], pa.int64()), "n": pa.array([n], pa.int64()), "words": pa.array([zlib.compress(b"\n".join(at), 1)], pa.binary()), "tokens": pa.array([zlib.compress(wide, 1)], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64())), "train": pa.array([train], pa.list_(pa.bool_()))}
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for b in batches:
            for doc, x, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                own = tokens(x.as_py() or b"")
                parts.append(np.fromiter(map(at.__getitem__, own), np.int32, len(own)))
                ids.append(doc)
                train.append(t)
                rows += len(own)
                n += len(own) if t else 0
                if rows >= BLOCK:
                    yield out()
                    made += 1
                    at, parts, ids, train, rows, n = _Places({END: 0}), [], [], [], 0, 0
        if ids:
            yield out()

    found = docs.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(run, "block long, n long, words binary, tokens binary, ids array<long>, train array<boolean>")
    return materialize(found)


def _words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b"\n")


def _stream(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one by one: a block is large."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _of_text(stream: np.ndarray, flags: list[bool]) -> np.ndarray:
    """The flag of its text for each token."""
    ends = np.flatnonzero(stream == 0)
    return np.repeat(np.array(flags, bool), np.diff(ends, prepend=-1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, tokens, train) -> word, n in training texts."""
    for b in batches:
        for words, data, train in _rows(b):
            stream, words = _stream(data), _words(words)
            n = np.bincount(stream[_of_text(stream, train)], minlength=len(words))
            some = np.flatnonzero(n)
            for lo in range(0, len(some), 50_000):
                part = some[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in part], pa.binary()), pa.array(n[part])], names=["word", "n"])


def _bigrams(blocks: DataFrame, held, many: int) -> DataFrame:
    """range, data: for the heavy words of a range, how often which context stands before and after each.

    A code is (side * words of a range + word) * (contexts) + other; the context ``many`` is that of all rarer words.
    """
    wide = -(-many // RANGES) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = held.value
        for batch in batches:
            for block, words, data, train in _rows(batch):
                stream = _stream(data)
                own = np.array([heavy.get(w, many) for w in _words(words)], np.int32)[stream]
                before = np.roll(own, 1)  # the stream ends with an end
                some = _of_text(stream, train) & ((own < many) | (before < many))
                code, n = np.unique(before[some].astype(np.int64) * (many + 1) + own[some], return_counts=True)
                a, b = code // (many + 1), code % (many + 1)
                left, right = a < many, b < many
                part = np.concatenate([a[left] // wide, b[right] // wide])
                code = np.concatenate([a[left] % wide * (many + 1) + b[left], (wide + b[right] % wide) * (many + 1) + a[right]])
                n = np.concatenate([n[left], n[right]])
                order = np.lexsort((code, part))
                part, code, n = part[order], code[order], n[order]
                cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
                made = [_zip(np.diff(code[i:j], prepend=0), n[i:j]) for i, j in zip(cut, [*cut[1:], len(part)])]
                yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array([block] * len(cut), pa.int64()), pa.array(made, pa.binary())], names=["range", "block", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for range_, rows in _grouped(batches):
            code, n = rows
            yield pa.RecordBatch.from_arrays([pa.array([range_ >> 32], pa.int64()), pa.array([range_ & 0xFFFFFFFF], pa.int64()), pa.array([_zip(np.diff(code, prepend=0), n)], pa.binary())], names=["range", "block", "data"])

    kind = "range long, block long, data binary"
    found = blocks.select("block", "words", "tokens", "train").mapInArrow(run, kind)
    parts = -(-blocks.count() // FAN)
    while True:  # a range of very many blocks is summed in parts first
        key = (F.shiftleft("range", 32) + F.pmod(F.xxhash64("block"), F.lit(parts))).alias("key")
        found = found.select(key, "data").repartition("key").sortWithinPartitions("key").mapInArrow(added, kind)
        if parts <= 1:
            return materialize(found.select("range", "data"))
        parts = -(-parts // FAN)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """key, (code, n) summed over the rows of each key; what is held is as large as the sum, and a few rows."""
    key, codes, ns, rows = None, [], [], 0

    def total() -> tuple[np.ndarray, np.ndarray]:
        code, n = np.concatenate(codes), np.concatenate(ns)
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        cut = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.zeros(0, np.int64)
        return code[cut], np.add.reduceat(n, cut) if len(cut) else n

    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key is not None and k != key:
                yield key, total()
                codes, ns, rows = [], [], 0
            key = k
            step, n = _unzip(data)
            codes.append(np.cumsum(step))
            ns.append(n)
            rows += len(n)
            if rows > 4_000_000 and len(codes) > 1:
                code, n = total()
                codes, ns, rows = [code], [n], 0
    if key is not None:
        yield key, total()


def _cells(range_: int, data: bytes, classes: np.ndarray, many: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heavy words of a range, and tokens by class after and before each (columns: classes, then the rarer words)."""
    wide = -(-many // RANGES) or 1
    step, n = _unzip(data)
    code = np.cumsum(step)
    other = np.append(classes, k)[code % (many + 1)]
    sums = np.bincount(code // (many + 1) * (k + 1) + other, n, 2 * wide * (k + 1)).reshape(2, wide, k + 1)
    words = np.arange(range_ * wide, min((range_ + 1) * wide, many))
    return words, sums[0, : len(words)], sums[1, : len(words)]


def _likelier(both: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What a token of each class after it, and before it, says for the classes (columns) of a word."""
    smooth = both + 0.1
    gain = np.log(smooth) - np.log(smooth.sum(1))[:, None] - np.log(smooth.sum(0))[None, :]
    return gain[:k].T, gain[:, :k]


def exchange(bigrams: DataFrame, counts: np.ndarray, start: np.ndarray, total: int, k: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the heavy words after the last round, and the class bigrams (the last class is that of all rarer words)."""
    spark, many = bigrams.sparkSession, len(counts)
    classes = start.copy()

    def bigrams_of(held) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = np.zeros((k + 1, k + 1))
            for b in batches:
                for range_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words, after, before = _cells(range_, data, held.value, many, k)
                    np.add.at(both, held.value[words], after)
                    both[k] += np.bincount(held.value[words], before[:, k], k + 1)
            yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["both"])

        got = [np.frombuffer(r["both"]).reshape(k + 1, k + 1) for r in bigrams.mapInArrow(run, "both binary").collect()]
        both = np.sum(got, 0) if got else np.zeros((k + 1, k + 1))
        both[k, k] = max(0.0, total - both.sum())
        return both

    def moved(held, both: np.ndarray, turn: int) -> np.ndarray:
        behind, ahead = _likelier(both, k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for range_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words, after, before = _cells(range_, data, held.value, many, k)
                    value = after @ behind + before @ ahead
                    own, at = held.value[words], np.arange(len(words))
                    best = value.argmax(1)
                    move = (value[at, best] > value[at, own] + 1e-9) & (words % 2 == turn)
                    yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([np.where(move, best, own).astype(np.int64).tobytes()], pa.binary())], names=["words", "classes"])

        new = held.value.copy()
        for r in bigrams.mapInArrow(run, "words binary, classes binary").collect():  # HEAVY words at most
            new[np.frombuffer(r["words"], np.int64)] = np.frombuffer(r["classes"], np.int64)
        return new

    step = quiet = 0
    most, share = -np.inf, 0
    while True:
        held = spark.sparkContext.broadcast(classes)
        both = bigrams_of(held)
        some, out, into = both[both > 0], both.sum(1), both.sum(0)
        likelihood = (some * np.log(some)).sum() - (out[out > 0] * np.log(out[out > 0])).sum() - (into[into > 0] * np.log(into[into > 0])).sum()
        # two rounds in turn, one for each half of the words
        quiet = quiet + 1 if step and (share < FEW * total or likelihood <= most + 1e-4 * total) else 0
        if quiet == 2 or not total:
            return classes, both
        most = max(most, likelihood)
        new = moved(held, both, step % 2)
        share, classes = int(counts[new != classes].sum()), new
        held.unpersist()
        step += 1


def _contexts(held, classes, many: int, k: int):
    """(block, words, tokens, train) -> word, place (block and place there), cells: a byte for each class before, and k + 1 more after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, known = held.value, np.append(classes.value, k)
        for batch in batches:
            for block, words, data, train in _rows(batch):
                stream, words = _stream(data), _words(words)
                own = np.array([heavy.get(w, many) for w in words], np.int64)
                rare = np.flatnonzero(own == many)
                slot = known[own].astype(np.uint8)[stream]
                at = np.flatnonzero((own == many)[stream] & _of_text(stream, train))
                number = np.zeros(len(words), np.int64)
                number[rare] = np.arange(len(rare))
                where = number[stream[at]] << 8
                code = np.concatenate([where | slot[at - 1], where | slot[at + 1] + k + 1])  # before the first word is an end, as at the end
                code.sort()
                ends = np.concatenate([[0], np.cumsum(np.bincount(code >> 8, minlength=len(rare)))])
                cells = (code & 255).astype(np.uint8)
                for lo in range(0, len(rare), 50_000):
                    hi = min(lo + 50_000, len(rare))
                    off = (ends[lo : hi + 1] - ends[lo]).astype(np.int32)
                    data_ = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(cells[ends[lo] : ends[hi]].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in rare[lo:hi]], pa.binary()), pa.array((block << 31) + rare[lo:hi]), data_], names=["word", "place", "cells"])

    return run


def _placed(batches: Iterator[pa.RecordBatch], behind: np.ndarray, ahead: np.ndarray, k: int):
    """Whole words from sorted rows (word, place, cells): words, counts, classes, and for each row its word's number and place.

    Held between batches are the counts by class of the last word and the places of its rows, 8 bytes for each block that has it.
    """
    both = 2 * (k + 1)
    weight = np.concatenate([ahead, behind])
    word, sums, places = None, np.zeros(both), np.zeros(0, np.int64)

    def out(words, sums, number, places):
        n = sums[:, : k + 1].sum(1)
        return words, n.astype(np.int64), (sums @ weight).argmax(1), number, places

    for b in batches:
        if not b.num_rows:
            continue
        cells = b.column(2)
        off = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
        slots = np.frombuffer(cells.buffers()[2], np.uint8)[off[0] : off[-1]] if cells.buffers()[2] is not None else np.zeros(0, np.uint8)
        names = b.column(0)
        fresh = np.ones(len(names), bool)
        if len(names) > 1:
            fresh[1:] = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = names[0].as_py() != word
        number = np.cumsum(fresh)  # 0: the word held
        own = np.bincount(np.repeat(number, np.diff(off)) * both + slots, minlength=(number[-1] + 1) * both).reshape(-1, both)
        own[0] += sums.astype(own.dtype)
        words = [word, *names.filter(pa.array(fresh)).to_pylist()]
        at = b.column(1).to_numpy()
        last = int(number[-1])
        whole = number < last
        if last:
            skip = word is None
            rows = np.concatenate([np.zeros(len(places), np.int64), number[whole]])
            yield out(words[skip:last], own[skip:last], rows - skip, np.concatenate([places, at[whole]]))
            places = at[~whole]
        else:
            places = np.concatenate([places, at])
        word, sums = words[last], own[last]
    if word is not None:
        yield out([word], sums[None], np.zeros(len(places), np.int64), places)


def _rare(contexts: DataFrame, both: np.ndarray, k: int) -> DataFrame:
    """block, bin, data, counts. Packs of place, count and class of the rarer words of a block; and, without a block, by bin the words of each
    class, then the sums of count + 1, then the number of words."""
    behind, ahead = _likelier(both, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, sizes, distinct, held, rows = np.zeros((BINS, k), np.int64), np.zeros(k, np.int64), 0, [], 0

        def packs() -> pa.RecordBatch:
            place, n, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(place)
            place, n, c = place[order], n[order], c[order]
            block = place >> 31
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            data = [_zip(np.diff(place[i:j] & 0x7FFFFFFF, prepend=0), n[i:j], c[i:j]) for i, j in zip(cut, [*cut[1:], len(place)])]
            return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.nulls(len(cut), pa.int32()), pa.array(data, pa.binary()), pa.nulls(len(cut), pa.list_(pa.int64()))], names=["block", "bin", "data", "counts"])

        for words, n, c, number, places in _placed(batches, behind, ahead, k):
            seen = n > 0
            where = np.array([bin_of(w) for w in words], np.int64)
            np.add.at(bins, (where[seen], c[seen]), 1)
            sizes += np.bincount(c[seen], n[seen] + 1, k).astype(np.int64)
            distinct += int(seen.sum())
            live = seen[number]
            held.append((places[live], n[number[live]], c[number[live]]))
            rows += int(live.sum())
            if rows > 400_000:
                yield packs()
                held, rows = [], 0
        if rows:
            yield packs()
        some = np.flatnonzero(bins.any(1))
        kinds, counts = [*some.tolist(), BINS, BINS + 1], [*bins[some].tolist(), sizes.tolist(), [distinct] + [0] * (k - 1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.nulls(len(kinds), pa.binary()), pa.array(counts, pa.list_(pa.int64()))], names=["block", "bin", "data", "counts"])

    by_word = contexts.repartition("word").sortWithinPartitions("word")
    return materialize(by_word.mapInArrow(run, "block long, bin int, data binary, counts array<long>"))


def _heavy(blocks: DataFrame, least: int) -> tuple[int, dict[bytes, int], np.ndarray]:
    """Tokens of the training texts; the heavy words with their places, in their own order, and their counts. The end is always among them."""
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = blocks.select("words", "tokens", "train").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where((F.col("n") * least >= total) | (F.length("word") == 0)).toArrow()
    found = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)) | ({} if total else {END: 0})
    words = sorted(found)
    return int(total), {w: i for i, w in enumerate(words)}, np.array([found[w] for w in words], np.int64)


def _fit(blocks: DataFrame, k: int, least: int):
    """The model without transitions, the packs of rarer words, their contexts and the class bigrams of the contexts."""
    sc = blocks.sparkSession.sparkContext
    total, heavy, counts = _heavy(blocks, least)
    held, many = sc.broadcast(heavy), len(heavy)
    start = np.array([zlib.crc32(w) % k for w in heavy], np.int64)
    classes, both = exchange(_bigrams(blocks, held, many), counts, start, total, k)
    known = sc.broadcast(classes)
    contexts = blocks.select("block", "words", "tokens", "train").mapInArrow(_contexts(held, known, many, k), "word binary, place long, cells binary")
    rare = _rare(contexts, both, k)
    bins, sizes, distinct = np.zeros((BINS, k), np.int64), np.zeros(k, np.int64), 0
    for r in rare.where("bin IS NOT NULL").groupBy("bin").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(k)]).alias("counts")).collect():
        if r["bin"] < BINS:
            bins[r["bin"]] = r["counts"]
        elif r["bin"] == BINS:
            sizes += r["counts"]
        else:
            distinct = r["counts"][0]
    for w, n, c in zip(heavy, counts, classes, strict=True):
        if n:
            bins[bin_of(w), c] += 1
            sizes[c] += n + 1
            distinct += 1
    bins[bins.sum(1) == 0] = bins.sum(0)
    model = Model(total, distinct, heavy, counts, classes, bins.argmax(1), np.log10(sizes + 1.0))
    return model, rare.where("block IS NOT NULL").select("block", "data"), contexts, both


def train(docs: DataFrame, k: int = CLASSES, least: int = HEAVY) -> tuple[Model, DataFrame]:
    """(text) of training rows -> model, and word, n, c of all words."""
    blocks = encode(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("train")))
    model, _, contexts, both = _fit(blocks, k, least)
    behind, ahead = _likelier(both, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n, c, _, _ in _placed(batches, behind, ahead, k):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(c)], names=["word", "n", "c"])

    rare = contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, c long")
    top = pa.table({"word": pa.array(list(model.heavy), pa.binary()), "n": model.counts, "c": model.classes})
    return model, docs.sparkSession.createDataFrame(top).where("n > 0").unionByName(rare)


def _classed(held):
    """(words, tokens, ids, train, packs) -> ids, train, ends, n_known, shares, emissions, stream of classes, class bigrams of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        k = len(m.room)
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for words, data, ids, train, packs in _rows(b):
                stream, words = _stream(data), _words(words)
                place = np.array([m.heavy.get(w, -1) for w in words], np.int64)
                n, c = np.where(place >= 0, m.counts[place], 0), np.where(place >= 0, m.classes[place], -1)
                for p in packs or ():
                    step, many, cls = _unzip(p)
                    at = np.cumsum(step)
                    n[at], c[at] = many, cls
                for i in np.flatnonzero(c < 0):
                    c[i] = m.unseen[bin_of(words[i])]
                ends = np.flatnonzero(stream == 0)
                starts = np.concatenate([[0], ends[:-1] + 1])
                own = c.astype(np.uint8)[stream]
                pairs = np.roll(own, 1).astype(np.int32) * k + own
                bigrams = np.bincount(pairs[_of_text(stream, train)], minlength=k * k)
                sums = np.add.reduceat(np.log10(n + 1.0)[stream], starts), np.add.reduceat(m.room[own], starts), np.add.reduceat((n > 0)[stream], starts, dtype=np.int64)
                made = ids, train, ends.astype(np.int64).tobytes(), sums[2].tobytes(), sums[0].tobytes(), (sums[0] - sums[1]).tobytes(), zlib.compress(own.astype(np.uint8).tobytes(), 1), bigrams.tolist()
                for column, v in zip(out, made, strict=True):
                    column.append(v)
            kinds = pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["ids", "train", "ends", "known", "share", "emission", "classes", "bigrams"])

    return run, "ids array<long>, train array<boolean>, ends binary, known binary, share binary, emission binary, classes binary, bigrams array<long>"


def fit_and_score(docs: DataFrame, k: int = CLASSES, least: int = HEAVY) -> tuple[Model, DataFrame]:
    """(doc_id, text, train) -> model, and doc_id, train, n_tokens, n_known, base_score, score of all rows; the model learns from those marked."""
    sc = docs.sparkSession.sparkContext
    blocks = encode(docs)
    model, rare, _, _ = _fit(blocks, k, least)
    held = sc.broadcast(model)
    lists = rare.groupBy(F.col("block").alias("__block")).agg(F.collect_list("data").alias("packs"))  # a block's words
    met = blocks.join(lists, F.col("block") == F.col("__block"), "left").select("words", "tokens", "ids", "train", "packs")
    classed = materialize(met.mapInArrow(*_classed(held)))
    sums = classed.select(F.posexplode("bigrams").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(k * k)
    for r in sums:
        both[r["at"]] = r["n"]
    both = both.reshape(k, k)
    of = both.sum(0) + 1
    transition = np.log10((both + SMOOTH * k * of / of.sum()) / (both.sum(1, keepdims=True) + SMOOTH * k))
    room = np.log10(model.total + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, train, ends, known, share, emission, data in _rows(b):
                ends, own = np.frombuffer(ends, np.int64), np.frombuffer(zlib.decompress(data), np.uint8)
                n, share = np.diff(ends, prepend=-1), np.frombuffer(share)
                path = np.add.reduceat(transition[np.roll(own, 1), own], np.concatenate([[0], ends[:-1] + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(train, pa.bool_()), pa.array(n), pa.array(np.frombuffer(known, np.int64)), pa.array(share - n * room), pa.array(np.frombuffer(emission) + path)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    cheap = classed.select("ids", "train", "ends", "known", "share", "emission", "classes")
    return model, cheap.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def op7_class_language_model(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, scores = fit_and_score(docs.withColumn("train", bucket_of(F.col("doc_id"), 7) != 2))
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
