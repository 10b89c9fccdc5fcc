"""Vector best-fit packing of documents into token sequences.

A piece demands a vector (tokens, 1 document, attention cost = tokens squared); a sequence has a
capacity in each of the three.  Pieces come in falling order of tokens and go to the open sequence
that fits under every constraint and scores best: smallest weighted norm of what would be left
(``norm``), or largest weighted dot product of demand and residual (``dot``).  Ties go to the
sequence opened first.

Packing takes two rounds of windows of ``window`` pieces, so memory has a bound.  The first works
within a task and needs no shuffle; of its sequences those with over ``LOOSE`` of every capacity left
are taken apart, and the second round packs their pieces again, dealt evenly to as few windows as
hold them.  What is wasted is the ends of the last few sequences of a window, whatever the number of
partitions.  The first round is written, the second deals rows in a fixed order, and sequence numbers
hold round and partition, so tasks that run again give the same numbers.

Defined cases: null text is empty text and is one piece, the closing id alone; documents longer than
the token capacity are cut into pieces of that capacity, the first of which may be shorter; very long texts are encoded
whole; equal rows are packed one by one, and null ids stay null; ties go to the sequence opened
first; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, only, stored

CAPACITY = (1024, 1024, 1024 * 1024)
WEIGHTS = (1.0, 0.01, 0.1)
WINDOW = 8192
LOOSE = 0.02
CACHE = 400_000
CLOSING_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


class Odd(Exception):
    """White space stands beside white space."""


class WordEncoder(dict):
    """Ids of a byte-level BPE as little-endian 32-bit bytes, remembered by white-space chunk.

    The pre-tokenizer never joins a non-space to the space or newline after it, so a text whose
    white space is single spaces and newlines falls apart before each of them.  Other texts are
    encoded whole.  The memory is emptied when it holds ``limit`` chunks.

    ``added`` are the tokenizer's added tokens and their ids; texts are split at them first, the
    leftmost and longest, as the tokenizer does.
    """

    def __init__(self, path: str, limit: int = CACHE, added: dict[str, int] | None = None):
        import tiktoken

        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit
        self.added = {token: array("I", [k]).tobytes() for token, k in (added or {}).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def plain(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == "\n" else chunk
        if not word or word[0].isspace() or word[-1].isspace():
            raise Odd
        if len(self) >= self.limit:
            self.clear()
        out = self[chunk] = self.plain(chunk if word is not chunk else " " + chunk)
        return out

    def encode(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.between(text)
        return b"".join(self.added.get(part) or self.between(part) for part in self.marks.split(text) if part)

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        head, *rest = text.replace("\n", " \n").split(" ")
        if not head or head[-1].isspace():
            return self.plain(text)
        try:
            return b"".join([self.plain(head), *map(self.__getitem__, rest)])
        except Odd:
            return self.plain(text)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON and their ids; those that match in other ways than by their text alone are refused."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in found):
        raise ValueError("an added token takes in what stands beside it")
    return {x["content"]: x["id"] for x in found}


def _pieces(capacity: int, path: str | None, with_ids: bool):
    """Of batches (doc_id, text) the pieces of every document."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path or tokenizer_path(), added=added_tokens(tokenizer_path("byte_bpe_50k.json")))
        closing = np.asarray([CLOSING_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = encoder.encode(text.as_py() or "") + closing
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a : 4 * b]
                        for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(own), own if with_ids else None)):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return pieces


def tokenize(docs: DataFrame, *, capacity: int = CAPACITY[0], path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document, with the CRC of their ids."""
    return only(docs, "doc_id", "text").mapInArrow(lean(_pieces(capacity, path, with_ids)), PIECES)


def best_fit(lengths: np.ndarray, capacity=CAPACITY, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece of one window."""
    n = len(lengths)
    cap, weight = np.asarray(capacity, dtype=float), np.asarray(weights, dtype=float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1) / cap
    if (demand > 1).any():
        raise ValueError("a piece is larger than a sequence")
    bins, offset = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.empty((0, 3))
    ids = np.empty(0, dtype=np.int64)
    used: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    least = demand.min(0) if n else cap
    eps = 1e-12
    grown = np.empty((256, 3))
    names = np.empty(256, dtype=np.int64)
    size = 0
    for i in order:
        d = demand[i]
        left, ids = grown[:size], names[:size]
        fits = (left >= d - eps).all(1).nonzero()[0]
        if len(fits):
            rest = left[fits]
            score = ((rest - d) ** 2) @ weight if rule == "norm" else -(rest @ (weight * d))
            at = int(fits[score.argmin()])
        else:
            if size == len(grown):
                grown, names = np.concatenate([grown, np.empty_like(grown)]), np.concatenate([names, np.empty_like(names)])
            at, size = size, size + 1
            grown[at], names[at] = 1.0, len(used)
            used.append(0)
        b = int(names[at])
        bins[i], offset[i] = b, used[b]
        used[b] += int(lengths[i])
        grown[at] -= d
        if (grown[at] < least - eps).any():  # full: nothing of this window fits any more
            grown[at : size - 1], names[at : size - 1] = grown[at + 1 : size].copy(), names[at + 1 : size].copy()
            size -= 1
    return bins, offset


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            whole = pa.Table.from_batches(held)
            for at in range(0, n - n % size, size):
                yield whole.slice(at, size).combine_chunks()
            held, n = whole.slice(n - n % size).to_batches(), n % size
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed(last: bool, capacity, weights, rule: str, window: int):
    """Of batches of pieces the pieces with their places; null places for those of loose sequences, but in the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = last << 61 | TaskContext.get().partitionId() << 36
        for part in _windows(batches, window):
            lengths = part.column("length").to_numpy()
            bins, offset = best_fit(lengths, capacity, weights, rule)
            left = 1 - np.stack([np.bincount(bins, lengths.astype(float) ** k) for k in (1, 0, 2)], 1) / np.asarray(capacity, dtype=float)
            loose = (left > LOOSE).all(1)[bins] & (not last)
            part = part.append_column("sequence_id", pa.array(bins + made, mask=loose)).append_column("offset", pa.array(offset, mask=loose))
            made += int(bins.max()) + 1
            yield from part.to_batches()

    return run


def _two_rounds(first: DataFrame, fit: tuple) -> DataFrame:
    """What the first round gave, with the pieces of its loose sequences packed again."""
    first, window = stored(first, "packed"), fit[-1]
    loose = first.where("sequence_id IS NULL").drop("sequence_id", "offset")
    again = loose.repartition(max(1, -(-loose.count() // window))).mapInArrow(lean(_packed(True, *fit)), PACKED)
    return first.where("sequence_id IS NOT NULL").unionByName(again)


def pack(pieces: DataFrame, *, capacity=CAPACITY, weights=WEIGHTS, rule: str = "norm", window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32, ids)."""
    fit = (capacity, weights, rule, window)
    return _two_rounds(pieces.mapInArrow(lean(_packed(False, *fit)), PACKED), fit)


def pack_documents(docs: DataFrame, *, capacity=CAPACITY, weights=WEIGHTS, rule: str = "norm", window: int = WINDOW, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; one worker a task cuts and packs."""
    fit = (capacity, weights, rule, window)
    cut, place = _pieces(capacity[0], path, with_ids), _packed(False, *fit)
    return _two_rounds(only(docs, "doc_id", "text").mapInArrow(lean(lambda batches: place(cut(batches))), PACKED), fit)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")
