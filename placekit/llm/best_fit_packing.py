"""Best-fit packing planned over the histogram of lengths.

A document is its token ids and one end id. Only documents longer than ``capacity`` are cut, into
pieces of ``capacity`` and a last one. The plan places counts of equal lengths, longest first, into
the sequences with the least room that fits; it has at most ``capacity`` counts for input and its
size doesn't follow the number of documents. Pieces then take the planned slots by their rank
within their length, for which no length has to be in one task.

Null texts are empty: the end id alone. Repeated rows are packed each for itself; rows that agree in
(doc_id, piece, ids_crc32) and length take their slots in either order. A null id is an id like any other.
A text of any length is tokenised whole. An empty table gives an empty table. Columns other than doc_id
and text are never read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import materialize, read_table, salted_rank

CAPACITY = 2048
PARTS = 32
#: Bytes of words and ids that a task remembers, about.
MEMORY = 150_000_000


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank, items, sequence, per, offset): the items of a length from this rank on go to the
    sequences from ``sequence`` on, ``per`` in each, one after the other from ``offset`` on.

    Best fit for counts: while items of a length remain, the group of sequences with the least room
    that fits takes as many in each as fit. Sequences of a group are alike and consecutive.
    """
    rows, used = [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, sequences)]
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length}")
        left, rank = histogram[length], 0
        fits = [r for r in room if r >= length and room[r]]
        heapq.heapify(fits)
        while left:
            if fits:
                r = fits[0]
                first, many = room[r].pop()
                if not room[r]:
                    heapq.heappop(fits)
                    del room[r]
            else:
                r, first, many = capacity, used, -(-left // (capacity // length))
                used += many
            per = min(r // length, left)
            whole = min(many, left // per)
            rows.append((length, rank, whole * per, first, per, capacity - r))
            rank, left = rank + whole * per, left - whole * per
            for rest, at, n in ((r - per * length, first, whole), (r, first + whole, many - whole)):
                if n and rest:
                    room[rest].append((at, n))
                    if rest >= length and rest not in fits:
                        heapq.heappush(fits, rest)
    return rows


def _byte_letters() -> dict[int, str]:
    """The letter that the byte-level alphabet has for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit numbers, the least byte first."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCoder(dict):
    """Ids of words between spaces, by the tokenizer of a file: a word is encoded when it is first looked up.

    Letters of ASCII and Latin-1, and the marks after them, are pieces of their own for the tokenizer; what it does
    before its model (composing, lowering letters, splitting, bytes to letters) is plain for them, so the model is
    asked straight away. Every other word goes through the whole tokenizer.
    """

    _PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    _MARKS = b".,!?*#$%&"

    def __init__(self, tokenizer: str, most: int = MEMORY) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(tokenizer)
        self._model, self._letters, self._most = self._whole.model, _byte_letters(), most
        self._size = 0

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        self[word] = ids
        self._size += len(word) + len(ids) + 160
        return ids

    def _piece(self, word: bytes) -> bytes:
        """Ids of plain letters, or of marks alone."""
        ids = self.get(word)
        if ids is None:
            text = word.decode().lower()
            text = text if text.isascii() else text.encode().decode("latin-1").translate(self._letters)
            ids = self._keep(word, _packed([t.id for t in self._model.tokenize(text)]))
        return ids

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(self._MARKS)
        if stem and not stem.isalpha() and not self._PLAIN.fullmatch(stem):
            return self._keep(word, _packed(self._whole.encode(word.decode(), add_special_tokens=False).ids))
        if stem and len(stem) < len(word):
            return self._keep(word, self._piece(stem) + self._piece(word[len(stem) :]))
        return self._piece(word) if word else b""

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))

    def bound(self) -> None:
        """Forget everything if more than the bytes allowed are remembered."""
        if self._size > self._most:
            self.clear()
            self._size = 0


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32.

    The tokenizer drops white space and never looks across it, so ids are found for each word once
    and put together; the words between spaces and line ends are given to it whole. It lowers letters
    itself: ASCII letters are lowered before, so that fewer words differ, unless a special token could come of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(tokenizer)
        tail = _packed([end])
        blank = bytes.maketrans(b"\n\r\t", b"   ")
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for lo in range(0, b.num_rows, 128):
                part = [(x.as_py() or b"").translate(blank) for x in b.column(1).slice(lo, 128).cast(pa.binary())]
                part = [(t if b"<|" in t else t.lower()).split(b" ") for t in part]
                for doc, words in zip(b.column(0).slice(lo, 128).to_pylist(), part, strict=True):
                    ids = coder.ids(words) + tail
                    coder.bound()
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        for column, v in zip(out, (doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with sequence_id and offset.

    The histogram that the driver plans over has ``capacity`` rows at most.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a table of slots, sorted: it is as large as the plan, which the capacity bounds
    slots = np.array(sorted(plan_best_fit(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(slots)
    ranked = salted_rank(pieces, ["length"], order, F.xxhash64(*order), PARTS, "__rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = plan.value
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        wide = np.int64(1) << 44  # more than any rank
        row = np.searchsorted(p[:, 0] * wide + p[:, 1], size * wide + at, side="right") - 1
        past = at - p[row, 1]
        return pd.DataFrame({"sequence_id": p[row, 3] + past // p[row, 4], "offset": p[row, 5] + past % p[row, 4] * size})

    return ranked.withColumn("__at", place("length", "__rank")).withColumn("sequence_id", F.col("__at.sequence_id")).withColumn("offset", F.col("__at.offset")).drop("__at", "__rank")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = materialize(tokenize(docs, tokenizer, capacity))  # tokens are made once
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
