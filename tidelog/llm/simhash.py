"""SimHash near-duplicate grouping by multi-index hashing.

Each text gets a 64-bit SimHash of its word shingles.  Fingerprints link when
they differ in at most ``max_bits`` bits.  The links come from two tables, one
for each 32-bit segment: two fingerprints within two bits of each other have
equal low segments or high segments at most one bit apart, so every
fingerprint enumerates the radius-one Hamming ball of its high segment and the
radius-zero ball of its low one, fetches the table entries and verifies the
whole distance.

A table entry with more than ``crowd`` fingerprints is not paired off.  Its
fingerprints enumerate the radius-one ball of the *other* segment as well; those
who meet in such a key are within two bits of each other by construction and
link to the smallest, so the work stays linear in any group's size and no link
is lost.

``tidelog.llm.neardup`` links texts by shingle similarity instead, with longer fingerprints.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows are
returned once each, with the same class; rows whose id is null take part and
are ignored by ``min``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels
from tidelog.llm.components import components

SEED = 42
CROWD = 64
#: Rows of one fingerprint beyond which its class is sent to all tasks that have such rows, instead of all rows to one.
HOT_ROWS = 1_000_000
#: Such fingerprints at most.
BROADCAST_ROWS = 200_000
_LOW = 0xFFFFFFFF


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hash of each shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - k + 1)


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of one text, as an unsigned number."""
    hashes = shingle_hashes(text, shingle)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` for each row; fp is the 64 bits as a signed long."""
    kernels.session(docs)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            fp = np.fromiter((fingerprint(x, shingle) for x in kernels.raw(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, "id long, fp long")


def _segments(f: DataFrame) -> DataFrame:
    """Each fingerprint's entry in both tables: segment number, its value, the other segment's value."""
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(_LOW)
    entry = lambda s, v, o: F.struct(F.lit(s).alias("s"), v.alias("v"), o.alias("o"))
    return f.select("fp", F.inline(F.array(entry(0, hi, lo), entry(1, lo, hi))))


def _ball(c: Column) -> Column:
    """A 32-bit value and the 32 values one bit from it."""
    return F.array(c, *[c.bitwiseXOR(1 << i) for i in range(32)])


def _join(hi: Column, lo: Column) -> Column:
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def links(f: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints to connect all within max_bits.

    Every link returned has been verified on the complete distance.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    table = _segments(f)
    sizes = table.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
    shared = sizes.filter("n > 1")
    entries = table.join(shared, ["s", "v"])

    # radius zero in either segment
    few = entries.filter(F.col("n") <= crowd)
    same = few.select("s", "v", F.col("fp").alias("a")).join(few.select("s", "v", F.col("fp").alias("b")), ["s", "v"]).filter("a < b").select("a", "b")
    many = entries.filter(F.col("n") > crowd).select("fp", "s", "v", F.explode(_ball(F.col("o"))).alias("m"))
    met = many.groupBy("s", "v", "m").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    crowded = many.join(met, ["s", "v", "m"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")

    # radius one in the high segment, probed from the side whose bit is 0
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(_LOW)
    bits = F.array(*[F.when(hi.bitwiseAND(1 << i) == 0, hi.bitwiseOR(1 << i)) for i in range(32)])
    probes = f.select("fp", lo.alias("lo"), F.explode(F.array_compact(bits)).alias("v"))
    hit = probes.join(sizes.filter("s = 0").select("v", "n"), "v")
    tried = hit.filter(F.col("n") <= crowd).join(table.filter("s = 0").select("v", F.col("fp").alias("b")), "v")
    near = tried.select(F.col("fp").alias("a"), "b")
    wide = hit.filter(F.col("n") > crowd).select(F.col("fp").alias("a"), F.explode(F.transform(_ball(F.col("lo")), lambda x: _join(F.col("v"), x))).alias("b"))
    exact = wide.join(f.select(F.col("fp").alias("b")), "b").select("a", "b")

    found = same.unionByName(crowded).unionByName(near).unionByName(exact)
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def groups(docs: DataFrame, shingle: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, fp, component_id`` (the smallest id reachable)."""
    fps = kernels.cut(fingerprints(docs, shingle, id_col, text_col))
    return _classes(fps, kernels.cut(links(kernels.cut(fps.select("fp").distinct()), max_bits)))


def _classes(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes are found on distinct fingerprints; rows of a fingerprint in great numbers stay where they are."""
    distinct = kernels.cut(fps.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    label = components(edges)
    named = distinct.join(label, distinct.fp == label.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = kernels.cut(named.join(least, "root").select("fp", "component_id", "n"))
    hot = classes.filter(F.col("n") > HOT_ROWS).select("fp", "component_id")
    n_hot = hot.count()
    if not 0 < n_hot <= BROADCAST_ROWS:
        return fps.join(classes.drop("n"), "fp").select("id", "fp", "component_id")
    few = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(classes.filter(F.col("n") <= HOT_ROWS).drop("n"), "fp")
    many = fps.join(F.broadcast(hot), "fp")
    return few.unionByName(many).select("id", "fp", "component_id")
