"""Substring dedup by prefix-partitioned suffix trees.

A *suffix* is a text from one of its words on.  A passage of ``WINDOW`` words or more repeats where two suffixes, together
with the words before them that agree as well, have that many words in common.  The suffix tree is sparse and never built whole:

1. *Which suffixes.*  Of the 8-word prefixes in a window the one whose hash is least is its anchor; equal windows have the same anchor
   in the same place, so it is enough to have the suffixes that start at anchors, about a seventh of all.  Anchors are
   counted with map-side sums; a suffix whose prefix occurs once is left out.
2. *Variable-length prefixes.*  A suffix goes to the group of its first 8 words if that group has at most ``GROUP`` suffixes.  A larger
   group is parted by longer prefixes: the suffixes from all window starts around the anchor, by their first WINDOW words.
   Each brings the words of the windows that its anchor stands for.  Of suffixes in one slice of documents that agree in
   all of them only the first leaves the task, so a passage in a third of all documents has one entry a slice.
3. *Subtrees.*  A group's suffixes are sorted by their words.  The common prefixes of neighbours span its internal nodes; at a node
   of depth r, leaves that agree in the l words before them as well have r + l words in common, and from WINDOW on that
   is a repeat, of which the leaf that comes first in the corpus stays and the others are marked.  Words are compared as they are.
   Groups of whole windows have a single node each, and are read through with only its first leaf in memory.
4. *Maximal repeats.*  Marks return to their documents, where they join into spans: the repeats as far as they reach.

Hashes (64 bits) deal suffixes into groups and find repeats inside one slice (128 bits there).  Defined cases: null texts have no words; rows with
a null id are left whole and do not count as earlier; rows that repeat an id are compared as the
same place, so neither removes the other; texts of fewer than WINDOW words lose nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

WINDOW = 20
ANCHOR = 8
#: Suffixes of one group that a task holds.
GROUP = 5_000
#: Anchors whose counts are sent to every task, so that their many places need not meet in one.
HOT_ANCHORS = 100_000
U64 = np.uint64


def _sliding(x: np.ndarray, k: int, f: Callable) -> np.ndarray:
    """f (minimum or maximum) over all k consecutive values; len(x) - k + 1 of them."""
    out, width = x, 1
    while width * 2 <= k:
        out = f(out[:-width], out[width:])
        width *= 2
    rest = k - width
    return f(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """All whole windows of some texts: text number, word number in it, the anchor's hash and its place among all words, window hashes."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = w = kernels.Words(texts)
        self.window = window
        h = w.hashes()
        self.start = np.flatnonzero(kernels.whole_windows(w, window))
        grams = kernels.window_hashes(h, ANCHOR)
        span = window - ANCHOR + 1
        self.grams = grams
        least = _sliding(grams, span, np.minimum) if len(self.start) else np.zeros(0, U64)
        self.anchor = least[self.start]
        self._least, self._hash, self._span = least, h, span
        self.text = np.searchsorted(w.first, self.start, "right") - 1
        self.place = self.start - w.first[self.text]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each anchor that some window has, once for each text and hash."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, U64)
        shown = np.zeros(len(self._least), dtype=U64)
        shown[self.start] = self.anchor
        pad = np.zeros(self._span - 1, dtype=U64)
        most = _sliding(np.concatenate((pad, shown, pad)), self._span, np.maximum)
        at = np.flatnonzero((most == self.grams) & (most > 0))
        return np.searchsorted(self.words.first, at, "right") - 1, self.grams[at]

    def anchor_words(self) -> np.ndarray:
        """For each window, the first word with the anchor's hash, among the words of all texts."""
        at = np.zeros(len(self.start), dtype=np.int64)
        open_ = np.arange(len(self.start))
        for d in range(self._span):
            hit = self.grams[self.start[open_] + d] == self.anchor[open_]
            at[open_[hit]] = self.start[open_[hit]] + d
            open_ = open_[~hit]
        return at

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every window."""
        a = kernels.window_hashes(self._hash, self.window)[self.start]
        b = kernels.window_hashes(kernels.finish(self._hash ^ U64(0xA5A5A5A55A5A5A5A)), self.window)[self.start]
        return a, b


def _unpack(column: pa.Array) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in column.to_pylist()]


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, z``: texts compressed by document, for the shuffles by id; null ids are left out."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in kernels.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(x) for x in kernels.raw(b.column(1))], pa.binary())], names=["id", "z"])

    return src.mapInArrow(run, "id long, z binary")


def _repeated_anchors(docs: DataFrame, window: int, group: int, id_col: str, text_col: str) -> DataFrame:
    """``id, anchors`` (array of the document's anchors that occur twice or more anywhere), ``wide`` (those over the group limit)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            text, a = Windows(kernels.raw(b.column(1)), window).anchors()
            order = np.lexsort((a, text))
            text, a = text[order], a[order]
            first = np.ones(len(a), dtype=bool)
            first[1:] = (text[1:] != text[:-1]) | (a[1:] != a[:-1])
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(a)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[at])), pa.array(a[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["id", "a", "n"])

    found = src.mapInArrow(run, "id long, a long, n long")
    many = kernels.cut(found.groupBy("a").agg(F.sum("n").alias("total")).filter("total > 1"))
    many = many.withColumn("wide", F.col("total") > group)
    # no more than HOT_ANCHORS anchors can have more than the mean of so many
    all_ = many.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    least = max(group, all_ // HOT_ANCHORS)
    hot = F.broadcast(many.filter(F.col("total") > least).select("a", "wide"))
    cold = many.filter(F.col("total") <= least).select("a", "wide")
    places = found.select("id", "a")
    mine = places.join(hot, "a").unionByName(places.join(hot.select("a"), "a", "left_anti").join(cold, "a"))
    return mine.groupBy("id").agg(F.collect_list("a").alias("anchors"), F.collect_list(F.when(F.col("wide"), F.col("a"))).alias("wide"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return rows, lists.flatten().to_numpy(zero_copy_only=False)


def _pairs_in(row: np.ndarray, value: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each (row, value) is among (rows, values)."""
    if not len(rows):
        return np.zeros(len(row), dtype=bool)
    mix = lambda r, v: kernels.finish(v + r.astype(U64) * kernels._MUL)
    return np.isin(mix(row, value), mix(rows, values.view(U64)))


_LEAF = "k long, wide boolean, id long, start int, lead int, n int, words binary"


def _suffixes(window: int) -> Callable:
    """Task: documents with their repeated anchors -> suffixes in groups, and spans already known to repeat.

    Output: a suffix that starts ``lead`` words into ``words``, whose first one is word ``start`` of its document, and which stands
    for ``n`` windows from there on, in group ``k``; or, without words, a span of n windows from ``start`` that repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _unpack(batch.column(1))
            sizes = np.cumsum([len(x) for x in texts])
            at = 0
            while at < len(texts):
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + 2 * kernels.SLICE_BYTES, "right")))
                yield from one(texts[at:to], batch.slice(at, to - at))
                at = to

    def one(texts: list[bytes], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = Windows(texts, window)
        keep = np.flatnonzero(_pairs_in(v.text, v.anchor, *_flat(batch.column(2))))
        a, b = (x[keep] for x in v.hashes())
        start, text, anchor, at = v.start[keep], v.text[keep], v.anchor[keep], v.anchor_words()[keep]
        wide = _pairs_in(text, anchor, *_flat(batch.column(3)))
        # consecutive windows of one anchor are one suffix; in a wide group each is its own
        new = np.ones(len(keep), dtype=bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1]) | wide[1:]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(keep)))
        start, text, at, wide = start[first], text[first], at[first], wide[first]
        k = np.where(wide, b[first], anchor[first])
        lead = np.where(wide, 0, at - start)
        # equal in all its words: the same windows, so the same sums of their hashes, around the same place
        total = lambda x: np.add.reduceat(x, first) if len(first) else x
        x, y = total(kernels.finish(a + U64(1))), total(kernels.finish(b + U64(2))) + lead.astype(U64)
        ids, place = batch.column(0).to_numpy()[text], start - v.words.first[text]
        order = np.lexsort((place, ids, n, y, x, k))
        k, x, y, ids, place, n, lead, wide, start = (z[order] for z in (k, x, y, ids, place, n, lead, wide, start))
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (n[1:] != n[:-1])
        chief = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        mark = (ids != ids[chief]) | (place != place[chief])
        w = v.words
        begin, stop = w.start[start[new]], w.end[start[new] + n[new] + window - 2]
        data = w.data.tobytes()
        words = pa.array([data[p:q] for p, q in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())
        yield out(k[new], wide[new], ids[new], place[new], lead[new], n[new], words)
        if mark.any():
            spread = kernels.finish(ids[mark].astype(np.int64).view(U64) * kernels._MUL + place[mark].astype(U64))
            yield out(spread, wide[mark], ids[mark], place[mark], lead[mark], n[mark], pa.nulls(int(mark.sum()), pa.binary()))

    def out(k, wide, ids, start, lead, n, words) -> pa.RecordBatch:
        cols = [pa.array(k.view(np.int64)), pa.array(wide), pa.array(ids.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, lead, n)), words]
        return pa.RecordBatch.from_arrays(cols, names=["k", "wide", "id", "start", "lead", "n", "words"])

    return run


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def subtree(leaves: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """leaves: ``id, start, lead, n, words`` of one group's suffixes.  ``id, start, 1`` for each of their windows that a leaf before has too.

    The internal nodes come from a stack over the sorted suffixes, as intervals of leaves with their depth.  A node of depth r under one
    of depth q settles the windows that begin window - r to window - q - 1 words before its leaves: inside the node they
    agree from the suffix on, and the words before are compared.
    """
    rows = []
    for key, start, lead, n, words in leaves:
        w = words.split()
        rows.append((w[lead:], w[:lead][::-1], key, start + lead, lead - n + 1))
    rows.sort(key=lambda r: r[0])
    depth = [_common(x[0], y[0]) for x, y in zip(rows, rows[1:], strict=False)]
    stack = [(0, 0)]  # depth and first leaf of the open nodes
    for i, d in enumerate([*depth, 0]):
        begin = i
        while stack and stack[-1][0] > d:
            r, begin = stack.pop()
            yield from _node(rows[begin : i + 1], max(0, window - r), window - max(d, stack[-1][0] if stack else 0) - 1, window)
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, begin))


def _node(rows: list[tuple], low: int, high: int, window: int) -> Iterator[tuple[int, int, int]]:
    """Marks of the windows that begin low to high words before the leaves of a node."""
    most = max(len(r[1]) for r in rows)
    for before in range(low, min(high, most) + 1):
        first: dict[bytes, tuple[int, int]] = {}
        owners = []
        for r in rows:
            if r[4] <= before <= len(r[1]):
                mine = (r[2], r[3] - before)
                key = b" ".join(r[1][:before])
                owners.append((key, mine))
                if (old := first.get(key)) is None or mine < old:
                    first[key] = mine
        if len(first) < len(owners):
            for key, mine in owners:
                if mine != first[key]:
                    yield *mine, 1


def _two(a: tuple, b: tuple, window: int) -> Iterator[tuple[int, int, int]]:
    """As ``subtree`` for two leaves in the order of the corpus: one internal node at most, and one run of windows."""
    (id1, start1, lead1, n1, words1), (id2, start2, lead2, n2, words2) = a, b
    low, high = max(lead1 - n1, lead2 - n2) + 1, min(lead1, lead2)
    if words1 != words2 or lead1 != lead2:
        w1, w2 = words1.split(), words2.split()
        low = max(low, window - _common(w1[lead1:], w2[lead2:]))
        high = min(high, _common(w1[:lead1][::-1], w2[:lead2][::-1]))
    if low <= high and (id1, start1 + lead1) != (id2, start2 + lead2):
        yield id2, start2 + lead2 - high, high - low + 1


def _whole(rows: list[tuple], first: dict[bytes, tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Marks of whole windows of one group, in the order of their places: each sequence's first stays."""
    for key, start, _, _, words in rows:
        if first.setdefault(b" ".join(words.split()), (key, start)) != (key, start):
            yield key, start, 1


def _trees(window: int) -> Callable:
    """Task: suffixes in the order of their groups -> marked spans ``id, start, n``."""

    def group(rows: list[tuple], first: dict | None) -> Iterator[tuple[int, int, int]]:
        if first is not None:
            yield from _whole(rows, first)
        elif len(rows) == 2:
            yield from _two(*sorted(rows, key=lambda r: (r[0], r[1] + r[2])), window)
        elif len(rows) > 2:
            yield from subtree(rows, window)

    def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the last group, which may go on in the next batch
        last, first = None, None
        for b in batches:
            known = b.column(6).is_null()
            spans = b.filter(known)
            yield pa.RecordBatch.from_arrays([spans.column(2), spans.column(3), spans.column(5)], names=["id", "start", "n"])
            b = b.filter(pa.compute.invert(known))
            if not b.num_rows:
                continue
            k, wide = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edge = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (wide[1:] != wide[:-1])) + 1).tolist(), len(k)]
            rows = list(zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True))
            found: list[tuple[int, int, int]] = []
            for lo, hi in zip(edge, edge[1:], strict=False):
                name = (int(k[lo]), bool(wide[lo]))
                if name != last:
                    if len(held) > 1:
                        found += group(held, None)
                    held, last, first = [], name, {} if name[1] else None
                if first is not None:
                    found += group(rows[lo:hi], first)
                elif hi < len(rows) and not held:
                    if hi - lo > 1:
                        found += group(rows[lo:hi], None)
                else:
                    held += rows[lo:hi]
            yield out(found)
        if len(held) > 1:
            yield out(list(group(held, None)))

    return run


def marked(docs: DataFrame, window: int = WINDOW, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, starts, ns``: for each document with repeats, runs of windows that also start earlier."""
    if window < 2 * ANCHOR:
        raise ValueError(f"window must be {2 * ANCHOR} words at least")
    spark = kernels.session(docs)
    anchors = kernels.cut(_repeated_anchors(docs, window, group, id_col, text_col))
    kernels.release(spark)
    known = _packed(docs, id_col, text_col).join(anchors, "id").select("id", "z", "anchors", "wide")
    suffixes = known.mapInArrow(_suffixes(window), _LEAF)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartition(parts, "k").sortWithinPartitions("k", "wide", "id", "start")
    spans = ordered.mapInArrow(_trees(window), "id long, start int, n int")
    found = kernels.cut(spans.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")))
    kernels.release(spark)
    return found


def _removed(n: int, starts: np.ndarray, ns: np.ndarray, window: int) -> np.ndarray:
    """Whether each of n words is covered."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + ns + window - 1, -1)
    return np.cumsum(step)[:-1] > 0


def dedup(docs: DataFrame, window: int = WINDOW, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: ``id, n_words, n_removed, kept_sha256, spans`` (removed word ranges), and ``kept_text`` on request."""
    kernels.session(docs)
    found = marked(docs, window, group, id_col, text_col)
    schema = "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept_text string" * with_text
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def row(key, text: bytes, starts, ns) -> tuple:
        words = text.split()
        spans = []
        kept = words
        if starts:
            gone = _removed(len(words), np.array(starts, np.int64), np.array(ns, np.int64), window)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
        joined = b" ".join(kept)
        return key, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), spans, joined.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pair), pa.string()][: 5 + with_text]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [row(*x) for x in zip(part.column(0).to_pylist(), _unpack(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][: len(cols)])

    known = _packed(docs, id_col, text_col).join(found, "id", "left").select("id", "z", "starts", "ns")
    out = known.mapInArrow(run, schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor()
        for b in batches:
            none = [None] * b.num_rows
            z = pa.array([c.compress(x) for x in kernels.raw(b.column(1))], pa.binary())
            yield from run(iter([pa.RecordBatch.from_arrays([b.column(0), z, pa.array(none, pa.list_(pa.int32())), pa.array(none, pa.list_(pa.int32()))], names=["id", "z", "starts", "ns"])]))

    nameless = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is null")
    return out.unionByName(nameless.mapInArrow(whole, schema))
