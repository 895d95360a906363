"""Near duplicates by shingle similarity, found through SimHash and multi-index hashing.

Two texts are alike when they share ``similarity`` (0.8) of their distinct word shingles; classes are what chains of such
links reach.  64 bits cannot tell a similarity of 0.8 from a far lower one, so the fingerprints here are longer:

1. *Fingerprints.*  Each text's set of distinct shingles gets a 64-bit name and a SimHash.  Texts of one name are one from here on,
   so copies cost a row each in one map-side sum and nothing later.  ``layout`` sizes the rest by the number of rows: segments as
   wide as its logarithm asks for, so that an entry meets about as many strangers in a large table as in a small one, and as
   many segments as catch ``RECALL`` of the pairs of just that similarity.
2. *Balls.*  Each segment enumerates the small Hamming ball over its bits most in doubt, those whose sums are closest to even:
   they are the ones that differ between texts that are alike.  Who meets in a key is compared on 128 bits.
3. *First round.*  Of those it meets, each text keeps its closest partner and the first (in a hash order) of the very close
   ones.  These links, at most two a text, are counted out on the texts' shingles, and join most of each class.
4. *Second round.*  Partners, alike or not, make clusters.  In each of up to ``CLUSTER`` texts every pair across classes is compared.  So is
   every pair that meets in a key and is in different clusters, or in a larger one; those within
   the complete distance are counted out as well.  The largest class of a cluster or key is never compared with itself, so a group of copies
   costs as many comparisons as it has members, times the few of other classes beside it.  Crowded texts bring their
   shingles along, in blocks, and are counted where they meet: what leaves the task is a forest of counted links.
   At last each text is held against the one with the most links beside its partner: copies of one text that miss it meet each other.

No link is taken on fingerprints alone, none is dropped but one that a counted path implies, and no key, group or candidate list has a cap.
What the fingerprints can miss is a pair that meets in no segment: 1 % of the pairs at just 0.8 by the model in
``layout``, next to none at 0.85.

Defined cases: null and wordless texts are one class; a text with fewer words than a shingle is one shingle; rows that
repeat an id with other texts are texts of their own; null ids take part, come last in ``min`` and never merge rows by
themselves; an empty table gives an empty result; extra columns are kept and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import kernels
from tidelog.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Share of the pairs at just the wanted similarity that must meet in some segment.
RECALL = 0.99
#: Deviations beyond the mean distance at that similarity up to which a pair is counted out.
DEVIATIONS = 3.0
#: Words of 64 bits at least, so that the complete distance tells the similarity well.
LEAST_LANES = 6
#: Entries of a key that the first round compares with each other; a larger key goes through the second round whole.
CHUNK = 1024
#: Entries of a key beyond which the second round counts pairs where they meet; entries of a side of one such comparison.
CROWD = 8
BLOCK = 2048
#: Members of a cluster that is compared as a whole.
CLUSTER = 20_000
#: Entries of one key that one task of the first round takes, and the share of texts by which such keys are found.
HOT_KEY = 50_000
WATCHED = 64
#: Entries that are shuffled at one time, as segments; rows of a table that is sent to every task at most.
AT_ONCE = 9
BROADCAST_ROWS = 200_000
#: Entries that a task holds at once.
HELD = 200_000

U64 = np.uint64


@dataclass(frozen=True)
class Layout:
    """width: bits of a segment; doubts: bits of its ball; far, far_two: differing bits of the whole, and of 128, beyond which texts are not alike; close_two: those of texts that very likely are."""

    width: int
    doubts: int
    segments: int
    lanes: int
    far: int
    far_two: int
    close_two: int


@lru_cache
def layout(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> Layout:
    """Sizes for n rows.  A pair's sums are taken as normal with the correlation that its similarity gives; the chance that it meets
    in a segment comes from 4,000 seeded draws of that model."""
    width = min(46, max(16, math.ceil(math.log2(max(n, 2))) + 6))
    doubts = 3 if width < 32 else 4
    rho = 2 * similarity / (1 + similarity)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4_000, width))
    b = rho * a + math.sqrt(1 - rho * rho) * rng.standard_normal((4_000, width))
    lost = (a > 0) != (b > 0)
    for x in (a, b):
        np.put_along_axis(lost, np.argsort(np.abs(x), axis=1)[:, :doubts], False, axis=1)
    met = float((~lost.any(axis=1)).mean())
    segments = math.ceil(math.log(1 - recall) / math.log(1 - met))
    lanes = max(LEAST_LANES, math.ceil(segments * width / 64))
    p = math.acos(rho) / math.pi
    far = lambda bits: math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))
    return Layout(width, doubts, segments, lanes, far(64 * lanes), far(128), math.floor(128 * p))


def _sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and in order, and where each text's begin (one more entry than texts)."""
    w = kernels.Words([x.lower() for x in texts])
    word, n = w.hashes(), w.counts
    text = w.texts_of_words()
    at = np.flatnonzero(kernels.whole_windows(w, shingle))
    found, owner = [kernels.window_hashes(word, shingle)[at]], [text[at]]
    for few in range(1, shingle):
        if len(short := np.flatnonzero(n == few)):
            found.append(kernels.window_hashes(word, few)[w.first[short]])
            owner.append(short)
    h, t = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return h, np.searchsorted(t, np.arange(len(texts) + 1))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of x from each first to the next; zero where there are none."""
    run = np.concatenate((np.zeros((1, *x.shape[1:]), dtype=x.dtype), np.cumsum(x, axis=0, dtype=x.dtype)))
    return run[first[1:]] - run[first[:-1]]


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: a sum, so that order does not matter, and the size."""
    size = np.diff(first).astype(U64)
    return kernels.finish(_sums(kernels.finish(h ^ U64(0x5851F42D4C957F2D)), first) + size * kernels._MUL)


def _simhash(h: np.ndarray, first: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Bits (texts x 64 lanes, 0 or 1) and doubts (texts x segments x doubts: places in the segment) of each set."""
    size = np.diff(first)
    # a byte counts up to 255 shingles; pieces of that many are summed eight bytes at a time
    pieces = -(-size // 255)
    of = np.repeat(np.arange(len(size)), pieces)
    begin = np.concatenate(([0], np.cumsum(pieces)))
    cut = first[of] + 255 * (np.arange(len(of)) - begin[of])
    total = np.zeros((len(size), 64 * lay.lanes), dtype=np.int64)
    for lane in range(lay.lanes if len(h) else 0):
        part = kernels.finish(h + U64((lane + 1) * int(kernels._MUL) % 2**64))
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        run = np.add.reduceat(bits.view(U64), cut, axis=0).view(np.uint8).astype(np.int64)
        total[:, 64 * lane : 64 * lane + 64] = _sums(run, begin)
    odds = 2 * total - size[:, None]
    used = np.abs(odds[:, : lay.segments * lay.width]).reshape(len(size), lay.segments, lay.width)
    doubts = np.argsort(used, axis=2, kind="stable")[:, :, : lay.doubts].astype(np.uint8)
    return (odds > 0).astype(np.uint8), doubts


def _lane_names(lay: Layout) -> list[str]:
    return [f"w{i}" for i in range(lay.lanes)]


def fingerprints(docs: DataFrame, lay: Layout, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, name, size`` (distinct shingles), ``w0, w1, ...`` and ``doubts`` for each row."""
    kernels.session(docs)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lanes = _lane_names(lay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            h, first = _sets(kernels.raw(b.column(1)), shingle)
            bits, doubts = _simhash(h, first, lay)
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            cols = [b.column(0), pa.array(_names(h, first).view(np.int64)), pa.array(np.diff(first).astype(np.int32))]
            cols += [pa.array(words[:, i].copy()) for i in range(lay.lanes)]
            cols.append(pa.array([x.tobytes() for x in doubts], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "name", "size", *lanes, "doubts"])

    return src.mapInArrow(run, "id long, name long, size int, " + ", ".join(f"{x} long" for x in lanes) + ", doubts binary")


def _entries(texts: DataFrame, lay: Layout, low: int, high: int, label: bool = False) -> DataFrame:
    """texts: ``name, w0, ..., doubts`` and perhaps ``label``.  ``key, mask, name, w0, w1`` (and ``label``) for each member of the
    balls of segments low to high: the key holds the segment and its value, the mask the bits in doubt."""
    lanes = _lane_names(lay)
    names = ["key", "mask", "name", "w0", "w1", *["label"] * label]
    flips = (np.arange(1 << lay.doubts)[:, None] >> np.arange(lay.doubts) & 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable((b.slice(i, 2000) for i in range(0, b.num_rows, 2000)) for b in batches):
            words = np.stack([b.column(1 + i).to_numpy() for i in range(lay.lanes)], axis=1)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            doubts = np.frombuffer(b"".join(b.column(1 + lay.lanes).to_pylist()), dtype=np.uint8).reshape(b.num_rows, lay.segments, lay.doubts)
            keys, masks = [], []
            for s in range(low, high):
                value = bits[:, s * lay.width : (s + 1) * lay.width].astype(np.int64) @ (1 << np.arange(lay.width, dtype=np.int64))
                one = np.int64(1) << doubts[:, s].astype(np.int64)
                mask = one.sum(axis=1)
                keys.append((value & ~mask)[:, None] + one @ flips.T + (s << 48))
                masks.append(np.broadcast_to(mask[:, None], keys[-1].shape))
            keys, masks = np.concatenate(keys, axis=1), np.concatenate(masks, axis=1)
            again = lambda x: pa.array(np.repeat(x, keys.shape[1]))
            cols = [pa.array(keys.ravel()), pa.array(masks.ravel()), again(b.column(0).to_numpy()), again(words[:, 0]), again(words[:, 1])]
            if label:
                cols.append(again(b.column(2 + lay.lanes).to_numpy()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = texts.select("name", *lanes, "doubts", *["label"] * label)
    return src.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int, held: int) -> Iterator[np.ndarray]:
    """Rows (all columns as int64) in pieces that end with a key's last row; a key of more than ``held`` rows is cut."""
    rest, n = [], 0
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            rest.append(np.stack([x.to_numpy() for x in b.columns], axis=1))
            n += b.num_rows
        if rest and (b is None or n >= held):
            rows = np.concatenate(rest)
            last = len(rows)
            if b is not None and (rows[0, :keys] != rows[-1, :keys]).any():
                last = int(np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(axis=1))[-1]) + 1
            yield rows[:last]
            rest, n = [rows[last:]], len(rows) - last


def _partners(lay: Layout) -> object:
    """Task of the first round: entries in key order -> ``name, bits, partner, rank, first`` for each entry that meets another:
    the closest one, and of the very close ones the first in a hash order.  Entries of keys over ``CHUNK`` come out in any case."""

    def piece(rows: np.ndarray, cut: int | None) -> pa.RecordBatch:
        """cut: the last key of the rows before; one that goes on here was too large to be held at once, however few of its rows are left."""
        rank = kernels.finish(rows[:, 2].view(U64)).view(np.int64)
        order = np.lexsort((rank, rows[:, 0]))
        rows, rank = rows[order], rank[order]
        key, mask, name = rows[:, 0], rows[:, 1], rows[:, 2]
        two = rows[:, 3:5].copy().view(U64)
        n = len(rows)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(start, n))
        size_of = np.repeat(size, size)
        if cut is not None:
            size_of = np.where(key == cut, CHUNK + 1, size_of)
        place = np.arange(n) - np.repeat(start, size)
        best = np.full(n, 1000, dtype=np.int64)
        who = np.zeros(n, dtype=np.int64)
        first = np.full(n, -1, dtype=np.int64)
        at = np.flatnonzero(size_of > 1)
        for d in range(1, CHUNK):
            at = at[at + d < n]
            at = at[(key[at] == key[at + d]) & (place[at] // CHUNK == place[at + d] // CHUNK)]
            if not len(at):
                break
            # a bit in doubt on both sides gives two common keys; the pair counts in the one where it is 0
            own = at[(key[at] & mask[at] & mask[at + d]) == 0]
            x, y = own, own + d
            bits = np.bitwise_count(two[x] ^ two[y]).sum(axis=1, dtype=np.int64)
            near = bits <= lay.far_two
            x, y, bits = x[near], y[near], bits[near]
            for p, q in ((x, y), (y, x)):  # within one step each entry has one partner on either side
                less = bits < best[p]
                best[p[less]], who[p[less]] = bits[less], name[q[less]]
            close = bits <= lay.close_two
            x, y = x[close], y[close]
            less = (first[y] < 0) | (x < first[y])
            first[y[less]] = x[less]
        out = np.flatnonzero((best < 1000) | (size_of > CHUNK))
        has, led = best[out] < 1000, first[out] >= 0
        lead = first[out]
        cols = [pa.array(name[out]), pa.array(best[out].astype(np.int32), mask=~has), pa.array(who[out], mask=~has), pa.array(rank[lead], mask=~led), pa.array(name[lead], mask=~led)]
        return pa.RecordBatch.from_arrays(cols, names=["name", "bits", "partner", "rank", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for rows in _whole_keys(batches, 1, HELD):
            yield piece(rows, cut)
            cut = int(rows[-1, 0])

    return run


def _sent(table: DataFrame) -> DataFrame:
    """A table that is sent to every task if it has few rows, and joined as it is if not."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _salted(entries: DataFrame, watched: DataFrame) -> DataFrame:
    """entries plus ``salt``: which part of its key an entry goes to.  Keys of over HOT_KEY entries are found among the entries of one
    in WATCHED texts; that steers how rows are dealt, not what is found, as large keys go through the second round whole."""
    seen = watched.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * WATCHED > HOT_KEY)
    hot = kernels.cut(seen.select("key", F.ceil(F.col("n") * WATCHED / HOT_KEY).cast("int").alias("parts")))
    if hot.isEmpty():
        return entries.withColumn("salt", F.lit(0))
    spread = entries.join(_sent(hot), "key", "left")
    return spread.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("name"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")


def first_round(texts: DataFrame, lay: Layout) -> DataFrame:
    """``name, partner, first``: a row for each text that has a partner within reach, or is in a crowded key."""
    spark = kernels.session(texts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    watched = texts.filter(F.pmod(F.xxhash64("name"), F.lit(WATCHED)) == 0)
    for low in range(0, lay.segments, AT_ONCE):
        high = min(low + AT_ONCE, lay.segments)
        entries = _salted(_entries(texts, lay, low, high), _entries(watched, lay, low, high))
        dealt = entries.repartition(parts, "key", "salt").select("key", "mask", "name", "w0", "w1").sortWithinPartitions("key")
        met = dealt.mapInArrow(_partners(lay), "name long, bits int, partner long, rank long, first long")
        best = lambda c, by: F.min(F.when(F.col(c).isNotNull(), F.struct(by, c))).alias(c)
        part = kernels.cut(met.groupBy("name").agg(best("partner", "bits"), best("first", "rank")))
        kernels.release(spark)
        found = part if found is None else found.unionByName(part)
    return kernels.cut(found.groupBy("name").agg(F.min("partner").alias("p"), F.min("first").alias("f")).select("name", F.col("p.partner").alias("partner"), F.col("f.first").alias("first")))


def _compare(lay: Layout) -> object:
    """Task of the second round: the rows of small cells ``key, i, j`` in order -> ``a, b``, names across classes that are within reach on 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches, 3, HELD):
            got = [(c[p, 5], c[q, 5]) for lo, hi in _cells(rows) for c in [rows[lo:hi]] for p, q in _meetings(c, lay)]
            if got:
                pairs = np.concatenate([np.stack((np.minimum(p, q), np.maximum(p, q)), axis=1) for p, q in got])
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def _cells(rows: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the cells of rows that are in order of ``key, i, j``."""
    edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
    return [(lo, hi) for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True) if hi - lo > 1]


def _meetings(c: np.ndarray, lay: Layout, root: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """c: one cell's ``key, i, j, side, mask, name, label, w0, w1``; side 0 is compared with side 1, and side 2 with all of the cell.
    A row and the rows across classes within its reach; root, where given, has the rows' classes as they are by then."""
    two = c[:, 7:9].copy().view(U64)
    label = c[:, 6] if root is None else root
    right = np.flatnonzero(c[:, 3] != 0)
    for p in np.flatnonzero(c[:, 3] != 1):
        q = right[right > p] if c[p, 3] == 2 else right
        q = q[(label[q] != label[p]) & ((c[p, 0] & c[p, 4] & c[q, 4]) == 0)]
        q = q[np.bitwise_count(two[q] ^ two[p]).sum(axis=1) <= lay.far_two]
        if len(q):
            yield p, q


def _settle(lay: Layout, similarity: float) -> object:
    """Task of the second round: the rows of crowded cells in order, with their shingles -> ``a, b``, counted links that connect what is alike in each."""

    def settled(c: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        place = np.concatenate(([0], np.cumsum(size)))
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(number) + 1, dtype=np.int64)
        _, root = np.unique(c[:, 6], return_inverse=True)
        for p, met in _meetings(c, lay, root):
            mine[own := number[place[p] : place[p + 1]]] = 1
            for q in met.tolist():
                if root[q] == root[p]:
                    continue
                shared = mine[number[place[q] : place[q + 1]]].sum()
                if shared >= similarity * (size[p] + size[q] - shared):
                    yield int(c[p, 5]), int(c[q, 5])
                    root[root == root[q]] = root[p]
            mine[own] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets = np.zeros((0, 9), dtype=np.int64), []
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                rows = np.concatenate((rows, np.stack([x.to_numpy() for x in b.columns[:9]], axis=1)))
                values, at = b.column(9).flatten().to_numpy(), b.column(9).offsets.to_numpy()
                sets += [values[i - at[0] : j - at[0]] for i, j in zip(at, at[1:], strict=False)]
            # the last cell may go on in the next batch
            last = 0 if not len(rows) else len(rows) if b is None else int(np.append(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)), -1).max()) + 1 if (rows[0, :3] != rows[-1, :3]).any() else 0
            done, rows = rows[:last], rows[last:]
            got = [x for lo, hi in _cells(done) for x in settled(done[lo:hi], sets[lo:hi])] if last else []
            sets = sets[last:]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _dealt(entries: DataFrame, block: int) -> DataFrame:
    """entries: ``key, mask, name, label, w0, w1``.  The rows of cells ``key, i, j, side, ...`` of the keys that hold several labels, and ``crowd``.

    In each key the largest label's entries are dealt into blocks that meet the blocks of the others, and those meet
    each other; the largest label's blocks do not meet.  Blocks of one key have about ``block`` entries.
    """
    sizes = entries.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    mixed = mixed.select("key", (F.col("n") > CROWD).alias("crowd"), F.col("m.label").alias("bulk"), blocks(F.col("m.n")).alias("kb"), blocks(F.col("n") - F.col("m.n")).alias("ko"))
    inside = entries.join(mixed, "key").withColumn("of_bulk", F.col("label") == F.col("bulk"))
    own = F.pmod(F.xxhash64("name"), F.when(F.col("of_bulk"), F.col("kb")).otherwise(F.col("ko"))).cast("int")
    inside = inside.withColumn("own", own)
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    # cells: (block of the others, block of the bulk) and, below zero, (block of the others, later block of the others)
    met = F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda o: cell(o, F.col("own"), F.lit(1)))
    other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("kb") - 1), lambda k: cell(F.col("own"), k, F.lit(0))),
        F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda k: cell(F.least(k, F.col("own")), -1 - F.greatest(k, F.col("own")), F.when(k == F.col("own"), 2).when(F.col("own") < k, 0).otherwise(1))),
    )
    return inside.select("key", "crowd", F.inline(F.when(F.col("of_bulk"), met).otherwise(other)), "mask", "name", "label", "w0", "w1")


_CELL = ("key", "i", "j", "side", "mask", "name", "label", "w0", "w1")


def _in_cells(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _counted_in_place(cells: DataFrame, sets: DataFrame, lay: Layout, similarity: float) -> DataFrame:
    whole = _in_cells(cells.join(sets, "name")).select(*[F.col(c).cast("long") for c in _CELL], "shingles")
    return kernels.cut(whole.mapInArrow(_settle(lay, similarity), "a long, b long"))


def inside_clusters(texts: DataFrame, sets: DataFrame, lay: Layout, similarity: float) -> DataFrame:
    """texts: ``name, label, cluster, w0, w1``.  ``a, b``: counted links that connect what is alike in each cluster."""
    entries = texts.select(F.col("cluster").alias("key"), F.lit(0).cast("long").alias("mask"), "name", "label", "w0", "w1")
    return _counted_in_place(_dealt(entries, BLOCK), sets, lay, similarity)


def across_keys(texts: DataFrame, sets: DataFrame, lay: Layout, similarity: float) -> tuple[DataFrame, DataFrame]:
    """texts: ``name, label, w0, ..., doubts``.  Two tables of ``a, b``: pairs of texts of different labels that meet in a small key and are within reach,
    and counted links from the crowded keys, enough to connect all that are alike there."""
    spark = kernels.session(texts)
    pairs = links = None
    for low in range(0, lay.segments, AT_ONCE):
        cells = kernels.cut(_dealt(_entries(texts, lay, low, min(low + AT_ONCE, lay.segments), label=True), BLOCK))
        few = _in_cells(cells.filter(~F.col("crowd"))).select(*[F.col(c).cast("long") for c in _CELL])
        part = kernels.cut(few.mapInArrow(_compare(lay), "a long, b long").distinct())
        counted = _counted_in_place(cells.filter("crowd"), sets, lay, similarity)
        kernels.release(spark)
        pairs = part if pairs is None else pairs.unionByName(part)
        links = counted if links is None else links.unionByName(counted)
    return pairs.distinct(), links


def _named(docs: DataFrame, shingle: int, text_col: str, name_as: str) -> DataFrame:
    """docs with the name of each row's set of shingles; rows pass through whole."""
    at = docs.columns.index(text_col)
    out = pa.field(name_as, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches, at):
            names = _names(*_sets(kernels.raw(b.column(at)), shingle)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names)], schema=b.schema.append(out))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name_as, T.LongType())]))


def _shingles(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """wanted: ``name, no_id, id``, one row that holds the text of each name.  ``name, shingles`` (distinct hashes); only texts of wanted rows move."""
    rows = _named(docs, shingle, "text", "name").withColumns({"no_id": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))})
    rows = rows.join(wanted, ["name", "no_id", "id"], "left_semi").select("name", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            h, first = _sets(kernels.raw(b.column(1)), shingle)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["name", "shingles"])

    # rows that repeat both id and text give one
    return rows.mapInArrow(run, "name long, shingles array<long>").groupBy("name").agg(F.min("shingles").alias("shingles"))


def _counted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a, b``) whose texts share ``similarity`` of their distinct shingles."""
    side = lambda n, s: sets.select(F.col("name").alias(n), F.col("shingles").alias(s))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _met(first: DataFrame) -> DataFrame:
    """``name, other`` for the partners that the first round found."""
    return first.select("name", F.explode(F.array_compact(F.array("partner", "first"))).alias("other"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).filter("a <> b").distinct()


def _beside_partners(first: DataFrame, sure: DataFrame) -> DataFrame:
    """``a, b``: each text with the neighbour, by counted links, that has the most of them among those of its partner."""
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    most = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    hub = both.join(most.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("n", "b")).alias("m"))
    return _pairs(_met(first).join(hub.select(F.col("a").alias("other"), F.col("m.b").alias("hub")), "other").select("name", F.col("hub").alias("other")))


def links(texts: DataFrame, docs: DataFrame, lay: Layout, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """texts: a row for each name; docs: ``id, text``.  ``a, b``: counted links that connect every class."""
    spark = texts.sparkSession
    full = texts.filter("size > 0")
    first = first_round(full, lay)
    wanted = full.join(first.select("name"), "name", "left_semi").select("name", F.col("lead.no_id").alias("no_id"), F.coalesce("lead.id", F.lit(0)).alias("id"))
    sets = kernels.cut(_shingles(wanted, docs, shingle))
    tried = kernels.cut(_pairs(_met(first)))
    sure = kernels.cut(_counted(tried, sets, similarity))
    label = components(sure).withColumnRenamed("node", "name").withColumnRenamed("root", "label")
    kernels.release(spark)  # hundreds of plans by now; their memory goes back
    cluster = components(tried).withColumnRenamed("node", "name").withColumnRenamed("root", "cluster")
    small = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") <= CLUSTER)
    cluster = cluster.join(small.select("cluster"), "cluster")
    near = full.join(first.select("name"), "name", "left_semi").join(label, "name", "left").join(cluster, "name", "left")
    near = kernels.cut(near.select("name", F.coalesce("label", "name").alias("label"), "cluster", *_lane_names(lay), "doubts"))
    kernels.release(spark)
    inside = inside_clusters(near.filter("cluster is not null"), sets, lay, similarity)
    kernels.release(spark)
    # what is in one small cluster has been compared as a whole
    met, crowd = across_keys(near.withColumn("label", F.coalesce("cluster", "label")), sets, lay, similarity)
    met = met.join(tried, ["a", "b"], "left_anti")
    kernels.release(spark)
    whole = lambda side: full.select(F.col("name").alias(side), F.array(*_lane_names(lay)).alias(f"{side}_w"))
    apart = F.aggregate(F.zip_with("a_w", "b_w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = met.join(whole("a"), "a").join(whole("b"), "b").filter(apart <= lay.far).select("a", "b")
    found = sure.unionByName(inside).unionByName(crowd).unionByName(kernels.cut(_counted(near, sets, similarity))).distinct()
    hubs = _beside_partners(first, found).join(tried, ["a", "b"], "left_anti").join(found, ["a", "b"], "left_anti")
    return found.unionByName(kernels.cut(_counted(hubs, sets, similarity)))


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``id, name``, and for each name ``root`` (its class), ``lead`` (no_id, id, n: the name's first id and how many rows have both), and whether
    it is the name of ``unlike`` texts, of which ten billion are expected to have a handful."""
    lay = layout(docs.count(), similarity)
    rows = kernels.cut(fingerprints(docs, lay, shingle, id_col, text_col))
    kept = ["size", *_lane_names(lay), "doubts"]
    by_id = rows.groupBy("name", "id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in kept])
    lead = F.struct(F.col("id").isNull().alias("no_id"), "id", "n")
    # unlike sets of one 64-bit name differ in 128 bits of their sums or in size
    mark = F.struct("w0", "w1", "size")
    texts = by_id.groupBy("name").agg(F.min(lead).alias("lead"), *[F.first(c).alias(c) for c in kept], F.min(mark).alias("least"), F.max(mark).alias("most"))
    texts = kernels.cut(texts.withColumn("unlike", ~F.col("least").eqNullSafe(F.col("most"))).drop("least", "most"))
    kernels.release(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = links(texts, src, lay, shingle, similarity)
    kernels.release(docs.sparkSession)
    label = components(counted)
    kernels.release(docs.sparkSession)
    named = texts.join(label.withColumnRenamed("node", "name"), "name", "left")
    return rows.select("id", "name"), kernels.cut(named.select("name", F.coalesce("root", "name").alias("root"), "lead", "unlike"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, name, component_id`` (the smallest id of its class; null if all are).  Texts that share a name but are not alike
    are each in a class of their own."""
    rows, names = classes(docs, shingle, similarity, id_col, text_col)
    least = names.groupBy("root").agg(F.min("lead.id").alias("component_id"))
    named = names.join(least, "root").select("name", "component_id", "unlike")
    return rows.join(named, "name").select("id", "name", F.when(F.col("unlike"), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of similar texts: the one with the smallest id (null last), and of several the one with the
    smallest name.  Of rows that share both id and name, any one stays.  Texts that share a name but are not alike all stay."""
    _, names = classes(docs, shingle, similarity, id_col, text_col)
    doubtful = names.filter("unlike").select("name")
    best = names.filter("not unlike").groupBy("root").agg(F.min(F.struct("lead.no_id", "lead.id", "name", "lead.n")).alias("m"))
    extra = kernels.free_names(docs, "name", "no_id", "id", "n")
    name, no_id, known, n = extra
    best = kernels.cut(best.select(F.col("m.name").alias(name), F.col("m.no_id").alias(no_id), F.coalesce("m.id", F.lit(0)).alias(known), F.col("m.n").alias(n)))
    rows = _named(docs, shingle, text_col, name)
    rows = rows.withColumns({no_id: F.col(id_col).cast("long").isNull(), known: F.coalesce(F.col(id_col).cast("long"), F.lit(0))})
    on = [name, no_id, known]
    apart = None if doubtful.isEmpty() else rows.join(doubtful.withColumnRenamed("name", name), name, "left_semi").select(*docs.columns)
    kept = rows.join(best.filter(F.col(n) == 1).select(*on), on, "left_semi").select(*docs.columns)
    if apart is not None:
        kept = kept.unionByName(apart)
    if best.filter(F.col(n) > 1).isEmpty():
        return kept
    repeated = rows.join(best.filter(F.col(n) > 1).select(*on), on, "left_semi").dropDuplicates(on)
    return kept.unionByName(repeated.select(*docs.columns))
