"""Extendible hashing: shards of bounded bytes, by DataFrame operations only.

The key's hash gives ``HASH_BITS`` bits.  A directory indexed by leading bits
points to shards; a shard over the byte limit splits on one more bit, others stay
as they are.  All levels of the directory are sums of the same finest histogram, so
the splits are decided by one aggregation over the rows (with map-side sums) and a
roll-up over its few entries; the histogram's depth grows only below the buckets
that are still over the limit, in further passes over these buckets alone.

Rows that agree in the whole hash (copies of one key) cannot be told apart by any
bit.  A bucket of such rows goes into numbered overflow pages: rows are dealt by
partition and a running sum of bytes inside each partition, so no task holds the
bucket.  A row larger than the limit has a page to itself.

Defined cases: null keys and texts hash as such and have no bytes beyond
``ROW_BYTES``; repeated rows are copies of one key; an empty table gives an empty
result; extra columns are kept whatever their names, and where the table has a column of an output's name, the output gets an
underscore behind its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import kernels

HASH_BITS = 60
#: Bytes that any row has besides its text.
ROW_BYTES = 16
#: Bits that one histogram pass adds.
STEP = 12
#: Directory entries up to which the directory is sent to every task.
BROADCAST_ENTRIES = 200_000


def hash_of(keys: Sequence[str]) -> Column:
    """The first 60 bits of the MD5 of the keys."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\u0001", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def row_bytes(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long")


def _prefix(h: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({h}, {HASH_BITS} - {depth})")


def directory(histogram: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """histogram: (p, bytes) with p of ``high`` bits.  The shards at depth low..high: ``depth, p, bytes, open``.

    A shard is the shortest prefix that fits; open tells those of depth ``high`` that still do not.
    """
    levels = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    tree = histogram.select(levels, F.col("p").alias("leaf"), "bytes").withColumn("p", F.expr(f"shiftright(leaf, {high} - depth)"))
    sums = tree.groupBy("depth", "p").agg(F.sum("bytes").alias("bytes"))
    above = sums.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"), F.col("bytes").alias("above"))
    inner = sums.withColumn("up", F.shiftright("p", 1)).join(above, ["depth", "up"], "left")
    begun = (F.col("depth") == low) | (F.col("above") > limit)
    ends = (F.col("bytes") <= limit) | (F.col("depth") == high)
    return inner.filter(begun & ends).select("depth", "p", "bytes", (F.col("bytes") > limit).alias("open"))


def shards(docs: DataFrame, limit: int, keys: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """docs plus ``shard_id`` (string: the prefix in binary, then ``+page`` for overflow pages),
    ``shard_depth`` and ``shard_bytes`` (of the whole bucket before pages).  Every shard fits the limit unless it is one larger row."""
    spark = docs.sparkSession
    src = docs.select(hash_of(keys).alias("h"), row_bytes(text_col).alias("bytes"))
    todo = kernels.cut(src.groupBy(_prefix("h", STEP).alias("p")).agg(F.sum("bytes").alias("bytes")))
    found, low, high = None, 0, STEP
    while True:
        level = kernels.cut(directory(todo, limit, low, high))
        closed = level.filter("not open").select("depth", "p", "bytes", F.lit(False).alias("full"))
        found = closed if found is None else found.unionByName(closed)
        still = level.filter("open").select("p")
        if still.isEmpty():
            break
        if high == HASH_BITS:
            found = found.unionByName(level.filter("open").select("depth", "p", "bytes", F.lit(True).alias("full")))
            break
        nxt = min(high + STEP, HASH_BITS)
        again = src.select(_prefix("h", high).alias("p"), _prefix("h", nxt).alias("q"), "bytes").join(still, "p", "left_semi")
        todo = kernels.cut(again.groupBy(F.col("q").alias("p")).agg(F.sum("bytes").alias("bytes")))
        low, high = high + 1, nxt
    found = kernels.cut(found)
    return _place(docs, found, limit, keys, text_col, spark)


def _place(docs: DataFrame, found: DataFrame, limit: int, keys: Sequence[str], text_col: str, spark) -> DataFrame:
    depths = sorted(r[0] for r in found.select("depth").distinct().collect())  # 61 values at most
    names = kernels.free_names(docs, "shard_id", "shard_depth", "shard_bytes", prefix="")
    if not depths:
        return docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, ("string", "int", "long"), strict=True)])
    small = found.count() <= BROADCAST_ENTRIES
    table = found.select("depth", "p", F.col("bytes").alias("total"), "full")
    table = F.broadcast(table) if small else table
    # rows travel as one struct, so their columns cannot meet the working ones
    rows = docs.select(F.struct("*").alias("row"), hash_of(keys).alias("h"), row_bytes(text_col).alias("bytes"))
    # the shards are disjoint, so exactly one of a row's prefixes is in the directory
    at = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix("h", d).alias("p")) for d in depths])
    if small:
        placed = rows.select("row", "h", "bytes", F.inline(at)).join(table, ["depth", "p"])
    else:
        where = rows.select("h").distinct().select("h", F.inline(at)).join(table, ["depth", "p"])
        placed = rows.join(where, "h")
    prefix = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("p"), F.col("depth").cast("int"), F.lit("0")))
    placed = placed.select("row", "bytes", prefix.alias("shard"), F.col("depth").cast("int").alias("depth"), "total", "full")
    if not found.filter("full").isEmpty():
        placed = _pages(placed, limit)
    return placed.select("row.*", *[F.col(c).alias(n) for c, n in zip(("shard", "depth", "total"), names, strict=True)])


def _pages(placed: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for buckets of equal hashes.

    A page belongs to one partition's rows of a bucket; inside, rows fill it in turn.  The running
    sum covers one partition's share only, and page numbers carry the partition's number.
    """
    rest = placed.filter("not full")
    full = placed.filter("full").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
    w = Window.partitionBy("shard", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row starts a page once half a limit has passed, so no page exceeds the limit unless its row does
    step = max(1, limit // 2)
    page = F.floor((F.sum("bytes").over(w) - F.col("bytes")) / step)
    alone = F.when(F.col("bytes") > step, F.concat(F.lit("."), F.col("seq"))).otherwise(F.lit(""))
    named = full.withColumn("page", page).withColumn("shard", F.concat("shard", F.lit("+"), "part", F.lit("."), "page", alone))
    return rest.unionByName(named.drop("part", "seq", "page"))
