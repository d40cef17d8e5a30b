"""Exact removal of repeated strings of bytes, by suffix arrays from two-stage sorting.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts anywhere else.
Copies of a whole text meet by a digest of 128 bits; repeats inside a text by hashes of its windows, whose bytes are then compared. For repeats
across texts, each window names an anchor: the leftmost least hash of a 96-byte gram in it. Equal
windows name equal anchors, so only the surroundings of anchors that occur twice can hold repeats.
These contexts are gathered by anchor, and a suffix array over them puts equal windows side by side:
only suffixes smaller than their successors are sorted directly, the others are induced from them
bucket by bucket, and neighbours whose common prefix reaches the length are repeats. An anchor of more than ``LARGE`` contexts
is a task of no executor: the windows of its contexts are sorted by 128 bits of a cryptographic hash over all executors instead.

Matches never cross texts. Null texts are empty. Equal texts of the length or more are removed
whole, repeated rows each get their row; ids play no part, and there are no ties. An empty table gives an empty table. Extra columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm import rolling
from placekit.llm.common import materialize, read_table, text_key, text_of, whole_groups

LENGTH, GRAM = 200, 96
#: Contexts of an anchor that one task compares; bytes of a suffix array.
LARGE, BUFFER = 5000, 1 << 21
#: Keys that a task remembers so as to read a copy once.
SEEN = 100_000
#: Grams of a window.
SPAN = LENGTH - GRAM + 1


def window_hashes(sums: np.ndarray, n: int, length: int) -> np.ndarray:
    at = np.arange(max(0, n - length + 1))
    return rolling.ranges(sums, at, at + length) if len(at) else np.zeros(0, np.uint64)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows at ``a`` have the bytes of those at ``b``."""
    view = sliding_window_view(data, LENGTH)
    return all((view[a[lo : lo + 4096]] == view[b[lo : lo + 4096]]).all() for lo in range(0, len(a), 4096))


def inner_repeats(data: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a text start twice in it, and which are the first of their kind. Hashes find them, bytes decide."""
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    twice, fresh = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
    if len(again):  # most texts repeat nothing, and one plain sort shows it
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, hashes), len(again) - 1)] == hashes)
        _, first, kind = np.unique(hashes[at], return_index=True, return_inverse=True)
        first = at[first][kind]
        if not _equal(data, at, first):  # strings of one hash that differ
            known: dict[bytes, int] = {}
            first = np.array([known.setdefault(data[i : i + LENGTH].tobytes(), i) for i in at.tolist()])
        _, kind, many = np.unique(first, return_inverse=True, return_counts=True)
        twice[at] = many[kind] > 1
        fresh[at] = first == at
    return twice, fresh


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` values stands, the leftmost of equals: two overlapping halves a step, whose width doubles."""
    at, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        at = np.where(values[:-step] <= values[step:], at[:-step], at[step:])
        values = np.minimum(values[:-step], values[step:])
        width += step
    return at


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the anchors of the first windows of each kind."""
    sums = rolling.prefixes(data)
    fresh = inner_repeats(data, window_hashes(sums, len(data), LENGTH))[1]
    grams = window_hashes(sums, len(data), GRAM)
    at = np.concatenate([leftmost_least(grams[lo : lo + 65536 + SPAN - 1], SPAN) + lo for lo in range(0, len(grams) - SPAN + 1, 65536)])
    windows = np.flatnonzero(fresh)
    at = at[windows]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[cut]], at[cut], windows[cut], windows[np.append(cut[1:], len(at)) - 1]


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The wanted suffixes of ``data`` in the order of their first ``depth`` bytes at least.

    ``data`` ends with a byte 0 of its own kind: suffixes shorter than the depth aren't wanted.
    """
    n = len(data)
    change = np.flatnonzero(np.diff(data.astype(np.int16)))  # data[i] != data[i + 1]
    nxt = np.searchsorted(change, np.arange(n))  # the change that ends the run of equal bytes at i
    safe = np.minimum(nxt, max(len(change) - 1, 0))
    end = np.where(nxt < len(change), change[safe] if len(change) else n - 1, n - 1)
    smaller = (end < n - 1) & (data[end] < data[np.minimum(end + 1, n - 1)])  # smaller than its successor
    need = np.zeros(n, bool)
    need[wanted] = True
    todo = np.asarray(wanted)
    while todo.size:  # a larger suffix needs its successor's place
        todo = todo[~smaller[todo] & (todo < n - 1)] + 1
        todo = todo[~need[todo]]
        need[todo] = True
    place = np.full(n, -1, np.int64)
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    direct = _sort_directly(padded, np.flatnonzero(need & smaller), depth)
    by_byte = np.split(direct, np.searchsorted(data[direct], np.arange(1, 256)))
    larger = np.flatnonzero(need & ~smaller)
    larger = larger[np.argsort(data[larger], kind="stable")]
    larger_by_byte = np.split(larger, np.searchsorted(data[larger], np.arange(1, 256)))
    done, out = 0, []
    for byte in range(256):
        bucket = larger_by_byte[byte]
        if len(bucket):
            run = end[bucket] - bucket
            for level in np.unique(run):  # a longer run of the byte is larger, and follows a shorter one
                part = bucket[run == level]
                part = part[np.argsort(place[np.minimum(part + 1, n - 1)], kind="stable")]
                place[part] = np.arange(done, done + len(part))
                done += len(part)
                out.append(part)
        part = by_byte[byte]
        place[part] = np.arange(done, done + len(part))
        done += len(part)
        out.append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    mask = np.zeros(n, bool)
    mask[wanted] = True
    return order[mask[order]]


def _words(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers in the order of the bytes."""
    return np.ascontiguousarray(sliding_window_view(padded, 8)[at]).view(">u8")[:, 0].astype(np.uint64)


def _sort_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the bytes from them on: 8 bytes a round, ties alone go on."""
    at = at.copy()
    lo, hi = np.array([0]), np.array([len(at)])  # ties, as ranges of ``at``
    for step in range(0, depth, 8):
        if not len(lo):
            break
        sizes = hi - lo
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        group = np.repeat(np.arange(len(lo)), sizes)
        words = _words(padded, at[where] + step)
        order = np.lexsort((words, group)) if len(lo) > 1 else np.argsort(words, kind="stable")
        at[where], words = at[where[order]], words[order]
        new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (group[1:] != group[:-1])])) if len(words) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(words)))
        tie = size > 1
        lo = where[new[tie]]
        hi = lo + size[tie]
    return at


def repeated_windows(data: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the wanted positions start a string of ``length`` bytes that another of them starts too."""
    order = two_stage_order(data, wanted, length)
    padded = np.concatenate([data, np.zeros(length + 16, np.uint8)])
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for step in range(0, length, 8):  # common prefixes of neighbours, as far as the length
        step = min(step, length - 8)
        live = live[_words(padded, a[live] + step) == _words(padded, b[live] + step)]
    hit = np.zeros(len(data), bool)
    hit[a[live]] = hit[b[live]] = True
    return hit[wanted]


def _runs(hit: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Bytes [start, end) that the windows marked in ``hit`` cover; ``first`` is the first window's start."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(first + int(a), first + int(b) - 1 + LENGTH) for a, b in edge.reshape(-1, 2)]


def _fresh(t: pa.Table) -> pa.Table:
    """Without the rows that are the same as the row before."""
    n = t.num_rows - 1
    same = functools.reduce(pc.and_, [pc.equal(c.slice(1), c.slice(0, n)) for c in t.columns])
    return t.filter(pa.array(np.concatenate([[True], ~same.to_numpy()])))


def _adjacent(columns: list[str]):
    """Rows that agree with a neighbour in ``columns``, from sorted batches; one row is held between batches. Equal rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = _fresh(pa.Table.from_batches([b] if held is None else [held[0], b]).combine_chunks()).combine_chunks()
            keys = [t.column(c).to_numpy() for c in columns]
            same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if held is not None:
                keep[0] |= held[1]
            yield from t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1])).to_batches()
            held = t.slice(t.num_rows - 1, 1).to_batches()[0], bool(keep[-1])
        if held is not None and held[1]:
            yield held[0]

    return run


def _flagged(limit: int):
    """Adds ``large``, whether more than ``limit`` rows have the anchor, to sorted batches; so many rows and one batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, big = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            a = t.column("anchor").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            many = np.diff(np.append(first, len(a)))
            large = (many > limit) | (False if big is None else a[first] == big)
            if large[-1]:  # its rows to come are known for such
                big, ready = a[-1], len(a)
            else:
                ready = int(first[-1])
            yield from t.append_column("large", pa.array(np.repeat(large, many))).slice(0, ready).combine_chunks().to_batches()
            held = t.slice(ready).combine_chunks() if ready < len(a) else None
        if held is not None:
            yield from held.append_column("large", pa.array(np.zeros(held.num_rows, bool))).to_batches()

    return run


def _anchors(texts: DataFrame) -> DataFrame:
    """key, anchor, place (position << 16, less of it the first window << 8, less of it the last).

    A text is read where it lies. Copies in different tasks, or far from each other in one, give the same rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for row, x in enumerate(b.column(1).cast(pa.binary())):
                key = b.column(0)[row].as_py()
                if key in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(key)
                data = np.frombuffer(x.as_py() or b"", np.uint8)
                if len(data) >= LENGTH:
                    h, at, lo, hi = anchors(data)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.binary()), pa.array(h.view(np.int64)), pa.array((at << 16) + ((at - lo) << 8) + (at - hi))], names=["key", "anchor", "place"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, rows = [], 0
        for b in run(batches):
            some.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                some, rows = [], 0
        if some:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    return texts.select("key", "text").mapInArrow(joined, "key binary, anchor long, place long")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, copies, places) -> anchor, key, place, context."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        size = 0
        for key, text, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            for p in places:
                at, lo, hi = p["place"] >> 16, p["place"] >> 8 & 255, p["place"] & 255
                for column, v in zip(out, (p["anchor"], key, p["place"], text[at - lo : at - hi + LENGTH]), strict=True):
                    column.append(v)
            size = sum(map(len, out[3][-len(places) :])) + size
            if size > 1 << 23:
                yield _batch(out)
                out, size = [[], [], [], []], 0
        if out[0]:
            yield _batch(out)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["anchor", "key", "place", "context"])


def _resolve(groups: list[dict[str, list]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, start, end) of the bytes that repeated windows cover, for the contexts of some anchors."""
    parts, starts, size, found = [], [], 0, []
    for g in groups:
        alike: dict[tuple[bytes, int], list[int]] = {}
        for i, (c, p) in enumerate(zip(g["context"], g["place"], strict=True)):
            alike.setdefault((c, p & 0xFFFF), []).append(i)
        for (c, span), rows in alike.items():
            windows = (span >> 8) - (span & 255) + 1
            if len(rows) > 1:
                found.append((g, rows, np.ones(windows, bool), span))
            if len(alike) > 1:  # a context of its own: it may share windows with others of the anchor
                if len(rows) == 1:
                    found.append((g, rows, (size, windows), span))
                starts.append(np.arange(size, size + windows))
                parts.append(c)
                size += len(c)
    if parts:
        data = np.frombuffer(b"".join(parts), np.uint8)
        wanted = np.concatenate(starts)
        hit = np.zeros(len(data), bool)
        hit[wanted] = repeated_windows(data, wanted)
    for g, rows, what, span in found:
        windows = what if isinstance(what, np.ndarray) else hit[what[0] : what[0] + what[1]]
        for i in rows:
            for a, b in _runs(windows, (g["place"][i] >> 16) - (span >> 8)):
                yield g["key"][i], a, b


def _spans(rows: Iterator[tuple[bytes, int, int]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "start", "end"])


def _by_suffix_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for g in whole_groups(batches, "anchor"):
        some.append(g)
        size += sum(map(len, g["context"]))
        if size > BUFFER:
            yield _spans(_resolve(some))
            some, size = [], 0
    if some:
        yield _spans(_resolve(some))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of large anchors -> w1, w2 (128 bits of each window), key, start."""
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            w1, w2, keys, starts = [], [], [], []
            for key, place, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                for i in range(len(c) - LENGTH + 1):
                    d = hashlib.blake2b(c[i : i + LENGTH], digest_size=16).digest()
                    w1.append(int.from_bytes(d[:8], "little", signed=True))
                    w2.append(int.from_bytes(d[8:], "little", signed=True))
                    keys.append(key)
                    starts.append((place >> 16) - (place >> 8 & 255) + i)
            yield pa.RecordBatch.from_arrays([pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(keys, pa.binary()), pa.array(starts, pa.int64())], names=["w1", "w2", "key", "start"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, copies, spans) -> key, n_bytes, n_removed, n_spans, kept."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for key, text, copies, spans in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            n = len(text)
            gone = np.zeros(n + 1, np.int64)
            if n >= LENGTH:
                if copies > 1:
                    gone[[0, n]] = 1, -1
                data = np.frombuffer(text, np.uint8)
                twice = inner_repeats(data, window_hashes(rolling.prefixes(data), n, LENGTH))[0]
                for a, e in [*_runs(twice, 0), *((s["start"], s["end"]) for s in spans or ())]:
                    gone[a] += 1
                    gone[e] -= 1
            cover = gone.cumsum()[:n] > 0
            removed = int(cover.sum())
            kept = text if not removed else np.frombuffer(text, np.uint8)[~cover].tobytes()
            runs = int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum())
            for column, v in zip(out, (key, n, removed, runs, kept), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(text, ...) -> key (of the text), n_bytes, n_removed, n_spans, kept (the bytes that stay), one row for each text."""
    # no key is null; said here, it is the same filter below all three joins, and their shuffle is one
    rows = docs.select(text_key().alias("key"), text_of().alias("text")).where("key is not null")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    named = _anchors(rows)
    pair, flag = _adjacent(["anchor"]), _flagged(LARGE)
    twice = named.repartition("anchor").sortWithinPartitions("anchor", "key", "place").mapInArrow(lambda batches: flag(pair(batches)), "key binary, anchor long, place long, large boolean")
    twice = materialize(twice)

    def contexts(of: DataFrame) -> DataFrame:
        # all joins with the texts take the same columns, and no checkpoint lies between
        places = of.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("anchor", "place")).alias("places"))
        return texts.join(places, F.col("key") == F.col("__key")).select("key", "text", "copies", "places").mapInArrow(_contexts, "anchor long, key binary, place long, context binary")

    small = contexts(twice.where("not large")).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_suffix_array, "key binary, start long, end long")
    windows = contexts(twice.where("large")).select("key", "place", "context").mapInArrow(_windows, "w1 long, w2 long, key binary, start long")
    windows = windows.repartition("w1").sortWithinPartitions("w1", "w2").mapInArrow(_adjacent(["w1", "w2"]), "w1 long, w2 long, key binary, start long")
    spans = small.unionByName(windows.select("key", "start", (F.col("start") + LENGTH).alias("end")))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("key", "__key")
    return texts.join(spans, F.col("key") == F.col("__key"), "left").select("key", "text", "copies", "spans").mapInArrow(_remove, "key binary, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs).select(F.col("key").alias("__key"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    out = docs.select("doc_id", text_key().alias("key")).join(done, F.col("key") == F.col("__key"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
