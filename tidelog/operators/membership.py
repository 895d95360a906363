"""Which incidents are in which bucket, as bitmaps: one of 4 KB for each bucket and 32,768 neighbouring ids.

A bucket of any size is many small rows, so no array of ids is ever gathered, and sets are combined block by
block: ``union``, ``intersect`` and ``minus`` meet only rows of the same block.  Runs of zeros go when
Spark compresses what it shuffles or writes.  Ids are whole numbers; a null id is in no set, a repeated one counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import incident as inc
from tidelog.functions import times
from tidelog.operators.analytics import TOP

#: Ids of one block, as Spark's bitmap functions cut them, and bytes of its bitmap.
WIDTH, BYTES = 32_768, 4096


def build(incidents: DataFrame, *keys: Column, **sums: Column) -> DataFrame:
    """``<keys>, block, bits`` and further aggregates of the rows of each block."""
    rows = incidents.filter("id is not null")
    return rows.groupBy(*keys, F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"), *[c.alias(n) for n, c in sums.items()])


def counts(sets: DataFrame, *keys: str) -> DataFrame:
    """``<keys>, count``: how many ids each set has."""
    return sets.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("count"))


# --- sets: frames of block, bits


def union(*sets: DataFrame) -> DataFrame:
    """Ids that are in any of the sets."""
    out = sets[0].select("block", "bits")
    for x in sets[1:]:
        out = out.unionByName(x.select("block", "bits"))
    return out.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that are in both sets; blocks without one are absent."""
    tagged = union(a).withColumn("n", F.lit(1)).unionByName(union(b).withColumn("n", F.lit(2)))
    both = tagged.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.sum("n").alias("n"))
    return both.filter((F.col("n") == 3) & (F.bitmap_count("bits") > 0)).select("block", "bits")


def _octets(bits: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BYTES)), lambda i: F.conv(F.hex(F.substr(bits, i, F.lit(1))), 16, 10).cast("int"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of the first set that aren't in the second."""
    joined = union(a).join(union(b).withColumnRenamed("bits", "less"), "block", "left")
    left = F.zip_with(_octets(F.col("bits")), _octets(F.col("less")), lambda x, y: F.lpad(F.hex(x.bitwiseAND(F.bitwise_not(y)).cast("long")), 2, "0"))
    bits = F.when(F.col("less").isNull(), F.col("bits")).otherwise(F.unhex(F.array_join(left, "")))
    return joined.select("block", bits.alias("bits")).filter(F.bitmap_count("bits") > 0)


def _first(block: Column) -> Column:
    """The id at position 0 of a block, and the step from one position to the next."""
    return F.when(block > 0, (block - 1) * WIDTH + 1).otherwise(block * WIDTH)


def ids(sets: DataFrame) -> DataFrame:
    """A frame with ``block, bits`` as one row for each ``id``; a block gives as many as it holds, at most 32,768."""
    keep = [c for c in sets.columns if c not in ("block", "bits")]
    octets = sets.select(*keep, "block", F.posexplode(_octets(F.col("bits"))).alias("__octet", "__bits")).filter("__bits > 0")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(F.col("__bits"), i) == 1))
    at = F.col("__octet") * 8 + F.col("__bit")
    step = F.when(F.col("block") > 0, at).otherwise(-at)
    return octets.select(*keep, "block", "__octet", bit.alias("__bit")).select(*keep, (_first(F.col("block")) + step).cast("long").alias("id"))


def rows_of(frame: DataFrame, chosen: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in a set (drill-down): they meet the set's one row for their block."""
    blocks = union(chosen).select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    octet = F.substr("__bits", F.expr(f"bitmap_bit_position({column}) div 8 + 1").cast("int"), F.lit(1))
    has = F.getbit(F.conv(F.hex(octet), 16, 10).cast("int"), F.expr(f"bitmap_bit_position({column}) % 8").cast("int")) == 1
    return frame.withColumn("__block", F.bitmap_bucket_number(column)).join(blocks, "__block").filter(has).drop("__block", "__bits")


# --- the dashboard's buckets: <labels>, block, bits; count is of the whole bucket


def _with_count(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.join(counts(sets, *keys), [*keys])


def severity(incidents: DataFrame) -> DataFrame:
    return _with_count(build(incidents, inc.category("severity").alias("severity")), "severity")


def mix(incidents: DataFrame, column: str) -> DataFrame:
    out = _with_count(build(incidents, inc.category(column).alias("label")), "label")
    return out.select(F.concat(F.lit(f"{column}:"), "label").alias("key"), "label", "count", "block", "bits")


def histogram(measured: DataFrame, metric: str, name: str) -> DataFrame:
    out = _with_count(build(measured, times.bucket(F.col(metric)).alias("b")), "b")
    return out.select(F.concat(F.lit(f"{name}:"), "b").alias("key"), times.bucket_label(F.col("b")).alias("label"), "count", "block", "bits")


def _merged(base: DataFrame, groups: DataFrame, order: list[Column], top: int, *sums: str) -> tuple[DataFrame, DataFrame]:
    """Each category's place, and the bitmaps (and sums) of the first ``top`` and of the rest, which is one set: OTHER.

    groups has a row for each category, so the window sees categories, not incidents.
    """
    placed = groups.withColumn("rn", F.row_number().over(Window.orderBy(*order))).withColumn("is_overflow", F.col("rn") > top)
    placed = placed.withColumn("label", F.when(F.col("is_overflow"), "OTHER").otherwise(F.col("k")))
    sets = base.select("k", "block", "bits", *sums).join(placed.select("k", "label", "is_overflow"), "k").groupBy("label", "is_overflow", "block").agg(F.bitmap_or_agg("bits").alias("bits"), *[F.sum(c).alias(c) for c in sums])
    return placed, sets


def top_by_count(incidents: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """``key, label, is_overflow, rn, count, block, bits, listed``; a category that is called OTHER stays apart from the rest.

    listed: how many ids the bucket's rows name in the block, repeated ones each time.
    """
    base = build(incidents, inc.category(column).alias("k"), listed=F.count("id"))
    placed, sets = _merged(base, counts(base, "k"), [F.desc("count"), F.col("k")], top, "listed")
    sums = placed.groupBy("label", "is_overflow").agg(F.sum("count").alias("count"), F.min("rn").alias("rn"))
    return sums.join(sets, ["label", "is_overflow"]).select(F.concat(F.lit(f"{column}:"), "label").alias("key"), "label", "is_overflow", "rn", "count", "block", "bits", "listed")


def top_by_pain(measured: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """As ``top_by_count``, ranked by the sum of known impact: with ``pain_sum, pain_known_count``."""
    base = build(measured, inc.category(column).alias("k"), pain=F.sum(F.col("pain").cast("decimal(38,0)")), known=F.count("pain"))
    groups = base.groupBy("k").agg(inc.saturating_sum(F.col("pain")).alias("pain_sum"), F.sum(F.bitmap_count("bits")).alias("count"), F.sum("known").alias("pain_known_count"))
    placed, sets = _merged(base, groups, [F.desc("pain_sum"), F.desc("count"), F.col("k")], top)
    sums = placed.groupBy("label", "is_overflow").agg(inc.saturating_sum(F.col("pain_sum")).alias("pain_sum"), F.sum("count").alias("count"), F.sum("pain_known_count").alias("pain_known_count"), F.min("rn").alias("rn"))
    return sums.join(sets, ["label", "is_overflow"]).select(F.concat(F.lit(f"{column}_pain:"), "label").alias("key"), "label", "is_overflow", "rn", "pain_sum", "count", "pain_known_count", "block", "bits")


def crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a_label, b_label, count``: how many incidents each bucket of one kind shares with each of another; pairs without any are absent.

    a, b: ``label, block, bits``.  Buckets meet inside a block, and a block has a row for each bucket only.
    """
    met = a.select("block", F.col("label").alias("a_label"), F.col("bits").alias("a")).join(b.select("block", F.col("label").alias("b_label"), F.col("bits").alias("b")), "block")
    one = F.explode(F.array("a", "b")).alias("bits")
    both = met.select("block", "a_label", "b_label", one).groupBy("block", "a_label", "b_label").agg(F.bitmap_and_agg("bits").alias("bits"))
    return both.groupBy("a_label", "b_label").agg(F.sum(F.bitmap_count("bits")).alias("count")).filter("count > 0")


def _met(buckets: DataFrame, incidents: DataFrame, *sums: Column) -> DataFrame:
    """The buckets' ids and the table's, block by block; ``equal``: the bits of the buckets add up to those of their union, which is the bitmap of the table."""
    parts = buckets.groupBy("block").agg(F.sum(F.bitmap_count("bits")).alias("in_buckets"), F.bitmap_or_agg("bits").alias("bits"), *sums)
    met = parts.join(build(incidents).withColumnRenamed("bits", "all_bits"), "block", "full")
    return met.withColumn("equal", F.coalesce((F.col("bits") == F.col("all_bits")) & (F.col("in_buckets") == F.bitmap_count("all_bits")), F.lit(False)))


def reconciles(buckets: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: whether the buckets share no incident and together have them all, by bitmaps alone."""
    return _met(buckets, incidents).agg(
        F.coalesce(F.sum("in_buckets"), F.lit(0)).alias("count_sum"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_ids"),
        F.coalesce(F.sum(F.bitmap_count("all_bits")), F.lit(0)).alias("total"), F.coalesce(F.bool_and("equal"), F.lit(True)).alias("ok"),
    )


def reconciliation(counted: DataFrame, buckets: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: whether a data set's own counts add up to the total and the ids that its buckets list are all incidents, once each.

    counted has the data set's ``count``, made from rows and not from bitmaps; buckets are its members with ``listed``.  The total is of rows, so a
    repeated or missing id shows; ``ok`` also holds the buckets against the table block by block.
    """
    met = _met(buckets, incidents, F.sum("listed").alias("listed"))
    ids = met.agg(
        F.coalesce(F.sum("listed"), F.lit(0)).alias("n_ids"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_ids"), F.coalesce(F.bool_and("equal"), F.lit(True)).alias("equal")
    )
    sums = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"))
    total = incidents.agg(F.count(F.lit(1)).alias("total"))
    out = sums.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(total))  # one row each
    ok = F.col("equal")
    for c in ("count_sum", "n_ids", "distinct_ids"):
        ok = ok & (F.col(c) == F.col("total"))
    return out.select("count_sum", "n_ids", "distinct_ids", "total", ok.alias("ok"))
