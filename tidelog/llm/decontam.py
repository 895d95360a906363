"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are case-folded and freed of ASCII punctuation.  Every benchmark item offers all its
``N``-word sequences as seeds.  One pass finds the seeds in each document and aligns the item with the
words around each cluster of hits by Smith-Waterman over words; an alignment that the words of both sides
cannot bring to the threshold is left out unmade.  ``score`` is the alignment's score over that
of a whole copy; from ``THRESHOLD`` on the document is contaminated by the item.  Every such alignment that
holds N words in a row of the item is found; one that is edited within every N words has no seed and is not.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK_SEEDS`` seeds,
each of which is sent to the workers and meets all documents in one pass, so documents
are never shuffled and a passage in a third of them is no hot key.

Defined cases: a null text is empty; a document or item of fewer than N words matches nothing; a
repeated item or document row gives equal rows once each per document row; empty tables give an
empty result; extra columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

N = 3
BLOCK_SEEDS = 500_000
THRESHOLD = 0.5
#: Words between the first and last hit of one alignment window, so that its table stays small.
WINDOW = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1

_FOLD = bytearray(range(256))
for _b in range(256):
    if 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
    elif _b < 128 and not (48 <= _b <= 57 or 97 <= _b <= 122):
        _FOLD[_b] = 0x20
_FOLD = bytes(_FOLD)


def fold(text: bytes) -> bytes:
    if not text.isascii():
        text = text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return text.translate(_FOLD)


def words(texts: list[bytes]) -> tuple[kernels.Words, np.ndarray]:
    w = kernels.Words([fold(x) for x in texts])
    return w, w.hashes()


def _row(h: np.ndarray, hit: np.ndarray, ramp: np.ndarray, edge: int, least: int | None) -> np.ndarray:
    """The next row of an alignment table; scores below ``least`` start anew."""
    row = np.empty_like(h)
    row[0] = edge
    np.maximum(h[:-1] + np.where(hit, MATCH, MISMATCH), h[1:] + GAP, out=row[1:])
    if least is not None:
        np.maximum(row, least, out=row)
    return np.maximum.accumulate(row + ramp) - ramp


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and the text span [start, end).

    Two passes of a row each, so memory is that of the text span alone: one finds where the best alignment ends, one runs back from there.
    """
    ramp = np.arange(len(text) + 1) * -GAP
    h = np.zeros(len(text) + 1, dtype=np.int64)
    best, last, end = 0, 0, 0
    for i, x in enumerate(item):
        h = _row(h, text == x, ramp, 0, 0)
        if (top := int(h.max())) > best:
            best, last, end = top, i + 1, int(h.argmax())
    if not best:
        return 0, 0, 0
    back, ramp = text[:end][::-1], ramp[: end + 1]
    h = -ramp
    for i, x in enumerate(item[:last][::-1]):
        h = _row(h, back == x, ramp, (i + 1) * GAP, None)
        if int(h.max()) == best:
            return best, end - int(h.argmax()), end
    raise AssertionError("an alignment read backwards has the same score")


class Block:
    """A block of items: their words, and seed hashes in order with their items and places."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        w, h = words(texts)
        self.ids = ids
        self.items = [h[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
        grams = [kernels.window_hashes(x, N) for x in self.items]
        seed = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.lexsort((item, seed))
        self.seed, self.item = seed[order], item[order]
        self.unique, self.at = np.unique(self.seed, return_index=True)
        self.stop = np.append(self.at[1:], len(self.seed))

    def hits(self, h: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window positions whose hash is a seed, and the number of that unique seed."""
        if not len(self.unique) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.unique, h)
        k[k == len(self.unique)] = 0
        pos = np.flatnonzero((self.unique[k] == h) & inside)
        return pos, k[pos]

    def find(self, texts: list[bytes], threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item number, score, first word, end word) of each contaminated text and item."""
        w, h = words(texts)
        pos, k = self.hits(kernels.window_hashes(h, N), kernels.whole_windows(w, N))
        if not len(pos):
            return []
        times = self.stop[k] - self.at[k]
        entry = np.repeat(self.at[k] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        pos = np.repeat(pos, times)
        text = np.searchsorted(w.first, pos, "right") - 1
        item = self.item[entry]
        order = np.lexsort((pos, item, text))
        pos, text, item = pos[order], text[order], item[order]
        size = np.array([len(x) for x in self.items])[item]
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > size[1:])
        # a long cluster is taken in pieces; each hit has all its words around it in its own piece
        since = pos - pos[np.flatnonzero(new)][np.cumsum(new) - 1]
        new[1:] |= since[1:] // WINDOW != since[:-1] // WINDOW
        begins = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in zip(begins, [*begins[1:], len(pos)], strict=True):
            t, i = int(text[a]), int(item[a])
            lo, hi = int(w.first[t]), int(w.first[t + 1])
            own = self.items[i]
            # an alignment of the threshold holds the item's words and as many others as its matches can pay for
            reach = len(own) + math.ceil(MATCH * len(own) * max(0.0, 1 - threshold) / -GAP)
            start = max(lo, int(pos[a]) - reach)
            stop = min(hi, int(pos[b - 1]) + N + reach)
            common = min(np.isin(h[start:stop], own).sum(), np.isin(own, h[start:stop]).sum())
            if MATCH * int(common) / (MATCH * len(own)) < threshold:
                continue
            score, x, y = align(own, h[start:stop])
            s = score / (MATCH * len(own))
            if s >= threshold and s > best.get((t, i), (0.0,))[0]:
                best[t, i] = (s, start + x - lo, start + y - lo)
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_seeds: int) -> Iterator[Block]:
    """The items in blocks; no more than one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").distinct().orderBy("i", "t")
    ids: list[int] = []
    texts: list[bytes] = []
    seeds = 0
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"].encode())
        seeds += len(texts[-1]) // 2 + 1
        if seeds >= block_seeds:
            yield Block(ids, texts)
            ids, texts, seeds = [], [], 0
    if ids:
        yield Block(ids, texts)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """``id, item_id, score, first_word, end_word``: one row for each document and item that contaminates it."""
    spark = kernels.session(docs)
    schema = "id long, item_id long, score double, first_word long, end_word long"
    out = None
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    for block in blocks(benchmark, item_col, item_text, block_seeds):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for x in kernels.slices(batches):
                found = b.find(kernels.raw(x.column(1)), threshold)
                ids = x.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                cols = [pa.array([b.ids[f[1]] for f in found], pa.int64()), pa.array([round(f[2], 6) for f in found], pa.float64()), *[pa.array([f[i] for f in found], pa.int64()) for i in (3, 4)]]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "item_id", "score", "first_word", "end_word"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """docs without contaminated rows; rows pass through whole and are not shuffled."""
    spark = kernels.session(docs)
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text, block_seeds):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in kernels.slices(batches, at):
                keep = np.ones(x.num_rows, dtype=bool)
                keep[[f[0] for f in shared.value.find(kernels.raw(x.column(at)), threshold)]] = False
                yield x.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
