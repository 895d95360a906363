"""Prefix trie of conversations as a Cartesian tree over their sorted order.

Conversations are sorted by their turns, so that those with a common prefix are neighbours.  The LCP array
says how many turns each shares with the one before it.  A trie node of depth d is opened by the first conversation i
of an interval [i, r): it is one of the depths above lcp[i], and r is the next place with an LCP below d.  These next
(and, for parents, last) smaller values come from blocks of the sorted order: a stack inside each block; what stays open
goes to the block whose minimum is the first (last) below it and meets that block's prefix (suffix) minima there.  Equal
LCPs are one node, depths that no LCP names belong to the interval around them, and everything about subtrees
is a difference of running sums over the sorted order.

Sizes: a sort key holds only the turns that a conversation shares with another, 16 bytes each, so a long
conversation of its own has a short key; positions and prefix sums run across range partitions, so neither a long
conversation nor a common prefix has to fit a task.  The driver holds two numbers for each block of ``BLOCK`` conversations
and a row for each partition.

Defined cases: rows without a conversation id are left out; null roles and texts are empty; a null turn comes
first, equal turns by role and text.  Turns are told apart by 128 bits of MD5, prefixes by two 64-bit sums.
Conversations without turns are members of the root only.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

#: Conversations of one block of the sorted order.
BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
_BIG = 2**62


def running(ordered: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A range-partitioned, sorted frame with the columns ``values`` (longs) replaced by their running sums within each ``key`` (a long, first in the order).

    Sums inside a partition are made as its rows stream by; what a key has in earlier partitions is added when the result is read, from one row for each
    partition.  Sums wrap around.
    """
    kernels.session(ordered)
    columns = ordered.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", `__part` int, `__seq` long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last, carry = TaskContext.get().partitionId(), 0, None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(starts, len(k)))
            arrays = {c: batch.column(c) for c in columns}
            for n, v in enumerate(values):
                run = np.cumsum(batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.where(starts > 0, run[starts - 1], 0)
                if k[0] == last:  # the key goes on from the batch before
                    before[0] -= carry[n]
                run -= np.repeat(before, sizes)
                carry[n] = run[-1]
                arrays[v] = pa.array(run)
            last = k[-1]
            yield pa.RecordBatch.from_arrays([*arrays.values(), pa.array(np.full(len(k), part, np.int32)), pa.array(seq + np.arange(len(k)))], names=[*columns, "__part", "__seq"])
            seq += len(k)

    rows = kernels.cut(ordered.mapInArrow(local, schema))
    ends = rows.groupBy("__part").agg(F.min_by(key, "__seq").alias("first"), F.max_by(F.struct(key, *values), "__seq").alias("last")).orderBy("__part").collect()  # a row for each partition
    carries: dict[int, tuple[int, list[int]]] = {}
    so_far: tuple[int | None, list[int]] = (None, [0] * len(values))
    for r in ends:
        if r.first == so_far[0]:
            carries[r["__part"]] = so_far
        before = so_far[1] if r.first == so_far[0] == r.last[key] else [0] * len(values)
        so_far = (r.last[key], [(a + r.last[v] + 2**63) % 2**64 - 2**63 for a, v in zip(before, values, strict=True)])
    if not carries:
        return rows.drop("__part", "__seq")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, parts = batch.column(key).to_numpy(zero_copy_only=False), batch.column("__part").to_numpy(zero_copy_only=False)
            arrays = {c: batch.column(c) for c in columns}
            for p in np.unique(parts).tolist():
                if p in carries:
                    mine = (parts == p) & (k == carries[p][0])
                    for v, more in zip(values, carries[p][1], strict=True):
                        arrays[v] = pa.array(np.asarray(arrays[v]) + np.where(mine, np.int64(more), np.int64(0)))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=columns)

    return rows.mapInArrow(add, ordered.schema)


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, tid, words``: the turns of each conversation in order, with their identity and size."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    by = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    tid = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return running(ordered.select("conv_id", F.lit(1).cast("long").alias("pos"), tid.alias("tid"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "conv_id", ["pos"])


def grafted(found: DataFrame, every: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: (``conv_id, depth, tid, words``, ``conv_id, len``).

    Conversation c begins with the first h turns of c - c % every and goes on with its own after its first h; h is the CRC-32 of its decimal id modulo spread.
    """
    found = kernels.cut(found)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % every
    sizes = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    donors = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = kernels.cut(sizes.withColumns({"h": h, "base": base}).join(donors, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0)))))
    first = found.filter(F.col("pos") < spread).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "tid", "words")  # spread - 1 rows each
    heads = convs.select("conv_id", "base", "h").join(first, "base").filter("depth <= h").select("conv_id", "depth", "tid", "words")
    lacking = convs.filter("given < h").select("conv_id", (F.col("h") - F.col("given")).alias("lack"))
    own = found.filter(F.col("pos") > h).join(lacking, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("depth"), "tid", "words")
    return heads.unionByName(own), convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def _sorted(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``i, block, conv_id, len, key``: conversations by the turns that they share with others."""
    by = [F.col("conv_id"), F.col("depth")]
    bits = rows.select("conv_id", "depth", "tid", F.xxhash64("depth", "tid").alias("a"), F.xxhash64("tid", "depth").alias("b"))
    prefixes = running(bits.repartitionByRange(*by).sortWithinPartitions(*by), "conv_id", ["a", "b"])
    shared = prefixes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    keys = prefixes.join(shared, ["a", "b"], "left_semi").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "tid"))), lambda x: x.tid).alias("key"))
    frame = convs.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", F.array().cast("array<binary>")))
    order = [F.col("key"), F.col("len"), F.col("conv_id")]
    ordered = frame.repartitionByRange(*order).sortWithinPartitions(*order).select(F.lit(0).cast("long").alias("all"), "conv_id", "len", "key", F.lit(1).cast("long").alias("i"))
    return running(ordered, "all", ["i"]).withColumn("i", F.col("i") - 1).withColumn("block", F.expr(f"i div {BLOCK}")).drop("all")


def _lcp(table: pa.Table, per_block: int) -> pa.Table:
    """The shared turns of each row of a block with the row before it; the row before the block comes along."""
    table = table.sort_by("i")
    i, blocks, keys = table.column("i").to_numpy(), table.column("block").to_numpy(), table.column("key").to_pylist()
    out = np.full(len(i), -1, np.int64)  # the first of all opens the root too
    for k in range(1, len(i)):
        n = 0
        for x, y in zip(keys[k - 1], keys[k], strict=False):
            if x != y:
                break
            n += 1
        out[k] = n
    mine = pa.array(i // per_block == blocks)
    return table.drop_columns(["key"]).append_column("lcp", pa.array(out)).filter(mine)


_PIECES = "kind int, a long, lo long, hi long, at long, least long"
_SEGMENT, _OPEN, _PREFIX, _OPENER, _ASKED, _SUFFIX = range(6)


def _solve(table: pa.Table, lows: np.ndarray, leasts: np.ndarray, total: int) -> pa.Table:
    """One block: intervals that end in it, those still open with the block where they end, its prefix and suffix minima, openers.

    A segment is (a, lo, hi]: the depths that conversation a opened, as far as they end at one place ``at``; least: the smallest id within.
    """
    table = table.sort_by("i")
    i, ids, lens, lcps = (table.column(c).to_pylist() for c in ("i", "conv_id", "len", "lcp"))
    block = table.column("block")[0].as_py()
    out: list[tuple] = []
    stack: list[list[int]] = []  # a, lo, hi, least id since it was pushed
    asked = set()
    low, least, last_low = _BIG, _BIG, _BIG
    for j, conv, size, v in zip(i, ids, lens, lcps, strict=True):
        if v < low:
            out.append((_PREFIX, block, v, low, j, least))
            low = v
        least = min(least, conv)
        folded = _BIG
        while stack and stack[-1][2] > v:
            top = stack[-1]
            top[3] = min(top[3], folded)
            if top[1] >= v:
                out.append((_SEGMENT, top[0], top[1], top[2], j, top[3]))
                folded = top[3]
                stack.pop()
            else:
                out.append((_SEGMENT, top[0], v, top[2], j, top[3]))
                top[2], folded = v, _BIG
        if stack:
            stack[-1][3] = min(stack[-1][3], folded)
            out.append((_OPENER, j, v, v, stack[-1][0], 0))
        elif v >= 0:
            asked.add(v)
        if size > v:
            stack.append([j, v, size, conv])
        elif stack:
            stack[-1][3] = min(stack[-1][3], conv)
    for v in asked:
        out.append((_ASKED, block, v, v, int(np.flatnonzero(lows[:block] < v)[-1]), 0))
    for j, v in zip(reversed(i), reversed(lcps), strict=True):
        if v < last_low:
            out.append((_SUFFIX, block, v, last_low, j, 0))
            last_low = v
    folded = _BIG
    for a, lo, hi, mine in reversed(stack):
        folded = min(folded, mine)
        while hi > lo:
            later = np.flatnonzero(lows[block + 1 :] < hi)
            if not len(later):
                out.append((_SEGMENT, a, lo, hi, total, int(min([folded, *leasts[block + 1 :].tolist()]))))
                break
            end = block + 1 + int(later[0])
            to = max(lo, int(lows[end]))
            out.append((_OPEN, a, to, hi, end, int(min([folded, *leasts[block + 1 : end].tolist()]))))
            hi = to
    columns = list(zip(*out, strict=True))
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[c.split()[0] for c in _PIECES.split(", ")])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of comma-joined ids of each run of equal ``l``; rows stream by in order."""
    key, digest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, ids = batch.column("l").to_numpy(zero_copy_only=False), batch.column("conv_id")
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))).tolist()
        for a, b in zip(starts, [*starts[1:], len(k)], strict=True):
            joined = ",".join(map(str, ids.slice(a, b - a).to_pylist())).encode()
            if int(k[a]) == key:
                digest.update(b"," + joined)
            else:
                if digest is not None:
                    yield pa.RecordBatch.from_pydict({"i": pa.array([key], pa.int64()), "ends": [digest.hexdigest()]})
                key, digest = int(k[a]), hashlib.sha256(joined)
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array([key], pa.int64()), "ends": [digest.hexdigest()]})


def _at(segments: str, depth: Column) -> Column:
    """The segment of a conversation that holds a depth."""
    return F.get(F.filter(segments, lambda s: (s.lo < depth) & (s.hi >= depth)), F.lit(0))


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    rows: ``conv_id, depth, tid, words``, depths from 1 without gaps; convs: ``conv_id, len``, every conversation once.
    """
    spark = kernels.session(rows)
    rows = kernels.cut(rows)
    found = kernels.cut(_sorted(rows, convs))
    per_block = BLOCK
    before = found.filter(F.col("i") % BLOCK == BLOCK - 1).withColumn("block", F.col("block") + 1)
    order = kernels.cut(found.unionByName(before).groupBy("block").applyInArrow(lambda t: _lcp(t, per_block), "conv_id long, len long, i long, block long, lcp long"))
    minima = order.groupBy("block").agg(F.min("lcp").alias("low"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("block").collect()  # a row for BLOCK conversations
    if not minima:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    total, lows, leasts = sum(r.n for r in minima), np.array([r.low for r in minima]), np.array([r.least for r in minima])
    pieces = kernels.cut(order.groupBy("block").applyInArrow(lambda t: _solve(t, lows, leasts, total), _PIECES))
    kind = lambda k, *names: pieces.filter(F.col("kind") == k).select(*(F.col(x).alias(y) for x, y in zip(("a", "lo", "hi", "at", "least"), names, strict=False)))

    # what ends in a later block meets that block's prefix minima; likewise openers in earlier blocks
    late = kind(_OPEN, "i", "lo", "hi", "block", "mn").join(kind(_PREFIX, "block", "v", "w", "r", "mn2"), "block").filter("v < hi AND w > lo")
    late = late.select("i", F.greatest("lo", "v").alias("lo"), F.least("hi", "w").alias("hi"), "r", F.least("mn", "mn2").alias("mn"))
    segments = kind(_SEGMENT, "i", "lo", "hi", "r", "mn").unionByName(late).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "r", "mn"))).alias("segs"))
    far = kind(_ASKED, "blk", "lcp", "x", "block").drop("x").join(kind(_SUFFIX, "block", "v", "w", "l2"), "block").filter("v < lcp AND w >= lcp").select(F.col("blk").alias("block"), "lcp", "l2")
    opened = kernels.cut(order.join(kind(_OPENER, "i", "x", "y", "l").drop("x", "y"), "i", "left").select("i", "block", "conv_id", "len", "lcp", "l"))
    outside = opened.filter("l IS NULL AND i > 0").drop("l").join(far, ["block", "lcp"]).withColumnRenamed("l2", "l")  # openers in earlier blocks
    placed = opened.filter("l IS NOT NULL OR i = 0").unionByName(outside).drop("block")
    kids = placed.filter("len > lcp AND i > 0").groupBy("l", "lcp").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("l").alias("i")).agg(F.collect_list(F.struct(F.col("lcp").alias("depth"), "n")).alias("kids"))
    copies = placed.filter("len = lcp").select("l", "conv_id")
    firsts = placed.join(copies.select(F.col("l").alias("i")).distinct(), "i", "left_semi").select(F.col("i").alias("l"), "conv_id")
    ends = copies.unionByName(firsts).repartition("l").sortWithinPartitions("l", "conv_id").mapInArrow(_ends, "i long, ends string")
    whole = placed.filter("len > lcp").join(segments, "i").join(kids, "i", "left").join(ends, "i", "left")
    whole = kernels.cut(whole.withColumn("ends", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))).withColumn("kids", F.coalesce("kids", F.array().cast("array<struct<depth:bigint,n:bigint>>"))))
    above = whole.select(F.col("i").alias("l"), F.col("segs").alias("above"))
    whole = whole.join(above, "l", "left").withColumn("over", _at("above", F.col("lcp")).mn).drop("above")

    kids_at = lambda depth: F.coalesce(F.get(F.filter("kids", lambda x: x.depth == depth), F.lit(0)).n, F.lit(0))
    # the root is depth 0 of the first conversation
    root = order.filter("i = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"))
    node = rows.select("conv_id", "depth", "words").unionByName(root).join(whole, "conv_id").filter("depth > lcp").withColumn("seg", _at("segs", F.col("depth")))
    node = kernels.cut(node.select(
        "i", "depth", F.col("seg.r").alias("r"), F.col("seg.mn").alias("conv_id"),
        F.when(F.col("depth") - 1 > F.col("lcp"), _at("segs", F.col("depth") - 1).mn).otherwise(F.col("over")).alias("parent_conv_id"),
        (F.col("seg.r") - F.col("i")).alias("n_convs"), (F.when(F.col("depth") < F.col("len"), 1).otherwise(0) + kids_at(F.col("depth"))).alias("n_children"),
        "words", F.when(F.col("depth") == F.col("len"), F.col("ends")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ))

    # running sums over the sorted order: of leaves by conversation, of saved tokens by node
    shared = node.filter("n_convs > 1").withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    by = [F.col("i"), F.col("depth")]
    summed = running(shared.withColumns({"all": F.lit(0).cast("long"), "saved": F.col("own")}).repartitionByRange(*by).sortWithinPartitions(*by), "all", ["saved"])
    leaf = node.groupBy("i").agg(F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.sum(F.when(F.col("n_convs") > 1, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).alias("tokens"))
    sums = order.select("i").join(leaf, "i", "left").select("i", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(0).cast("long").alias("all"))
    sums = kernels.cut(running(sums.repartitionByRange("i").sortWithinPartitions("i"), "all", ["leaves", "tokens"]))  # up to and with i
    start = sums.select((F.col("i") + 1).alias("i"), F.col("leaves").alias("leaves0")).unionByName(spark.createDataFrame([(0, 0)], "i long, leaves0 long"))
    stop = sums.select((F.col("i") + 1).alias("r"), F.col("leaves").alias("leaves1"), F.col("tokens").alias("tokens1"))
    full = summed.join(start, "i").join(stop, "r").withColumns({"n_leaves": F.col("leaves1") - F.col("leaves0"), "saved_tokens": F.col("tokens1") - F.col("saved") + F.col("own")})
    single = node.filter("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    both = full.select(*out).unionByName(single.select(*out))
    return both.withColumn("n_children", F.col("n_children").cast("long"))
