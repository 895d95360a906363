"""Distributions, rankings and impact sums.  Every result reconciles to the incident total and names its incidents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.functions import incident as inc
from tidelog.functions import times

TOP = 8


# Every distribution has two forms: with an array of ids in each row, for review-sized sets, or, with_ids=False, counts only. Members of
# buckets of any size are bitmaps, in operators/membership.py.


def _ids(with_ids: bool) -> list[Column]:
    return [F.array_sort(F.collect_list("id")).alias("incident_ids")] if with_ids else []


def _names(with_ids: bool) -> list[str]:
    return ["incident_ids"] if with_ids else []


def severity_counts(incidents: DataFrame, with_ids: bool = True) -> DataFrame:
    return incidents.groupBy(inc.category("severity").alias("severity")).agg(F.count(F.lit(1)).alias("count"), *_ids(with_ids)).orderBy("severity")


def category_mix(incidents: DataFrame, column: str, with_ids: bool = True) -> DataFrame:
    """``key, label, count, incident_ids`` by count, then label."""
    out = incidents.groupBy(inc.category(column).alias("label")).agg(F.count(F.lit(1)).alias("count"), *_ids(with_ids))
    return out.select(F.concat(F.lit(f"{column}:"), "label").alias("key"), "label", "count", *_names(with_ids)).orderBy(F.desc("count"), "label")


def duration_histogram(measured: DataFrame, metric: str, name: str, with_ids: bool = True) -> DataFrame:
    """``key, label, count, incident_ids`` by bucket; empty buckets are absent."""
    out = measured.groupBy(times.bucket(F.col(metric)).alias("b")).agg(F.count(F.lit(1)).alias("count"), *_ids(with_ids))
    return out.orderBy(times.bucket_rank(F.col("b"))).select(F.concat(F.lit(f"{name}:"), "b").alias("key"), times.bucket_label(F.col("b")).alias("label"), "count", *_names(with_ids))


def _ranked(groups: DataFrame, order: list[Column], top: int) -> DataFrame:
    # one row per category, so the window sees categories, not incidents
    rn = F.row_number().over(Window.orderBy(*order))
    return groups.withColumn("rn", rn).withColumn("over", F.col("rn") > top)


def _merged_ids(with_ids: bool) -> list[Column]:
    return [F.array_sort(F.flatten(F.collect_list("incident_ids"))).alias("incident_ids")] if with_ids else []


def top_by_count(incidents: DataFrame, column: str, top: int = TOP, with_ids: bool = True) -> DataFrame:
    """The largest categories, and one ``OTHER`` row (last, with ``is_overflow``, apart from a category of that name) for the rest."""
    groups = incidents.groupBy(inc.category(column).alias("k")).agg(F.count(F.lit(1)).alias("count"), *_ids(with_ids))
    ranked = _ranked(groups, [F.desc("count"), F.col("k")], top)
    label = F.when(F.col("over"), "OTHER").otherwise(F.col("k"))
    out = ranked.groupBy("over", label.alias("label")).agg(F.sum("count").alias("count"), *_merged_ids(with_ids), F.min("rn").alias("rn"))
    return out.orderBy("rn").select(F.concat(F.lit(f"{column}:"), "label").alias("key"), "label", "count", *_names(with_ids), F.col("over").alias("is_overflow"))


def top_by_pain(measured: DataFrame, column: str, top: int = TOP, with_ids: bool = True) -> DataFrame:
    """As ``top_by_count``, ranked by the sum of known impact, then count, then name."""
    groups = measured.groupBy(inc.category(column).alias("k")).agg(inc.saturating_sum(F.col("pain")).alias("pain_sum"), F.count(F.lit(1)).alias("count"), F.count("pain").alias("pain_known_count"), *_ids(with_ids))
    ranked = _ranked(groups, [F.desc("pain_sum"), F.desc("count"), F.col("k")], top)
    label = F.when(F.col("over"), "OTHER").otherwise(F.col("k"))
    out = ranked.groupBy("over", label.alias("label")).agg(
        inc.saturating_sum(F.col("pain_sum")).alias("pain_sum"), F.sum("count").alias("count"), F.sum("pain_known_count").alias("pain_known_count"), *_merged_ids(with_ids), F.min("rn").alias("rn"),
    )
    return out.orderBy("rn").select(F.concat(F.lit(f"{column}_pain:"), "label").alias("key"), "label", "pain_sum", "count", "pain_known_count", *_names(with_ids), F.col("over").alias("is_overflow"))


def with_pain(measured: DataFrame) -> DataFrame:
    return measured.withColumn("pain", inc.pain(F.col("impact_pct"), F.col("service_health_pct"), F.col("mttr_seconds")))


def with_warnings(incidents: DataFrame) -> DataFrame:
    return incidents.withColumns({"metric_warnings": inc.metric_warnings(), "validation_warnings": inc.validation_warnings()}).withColumn("warning_count", F.size("metric_warnings") + F.size("validation_warnings"))


def percentile(values: Column, p: int) -> Column:
    """Nearest rank on 0..n-1 of the known values: the sorted value at ``(n - 1) * p / 100``, rounded down."""
    known = F.array_sort(F.collect_list(values))
    at = F.floor((F.size(known) - 1) * p / 100).cast("int")
    return F.when(F.size(known) > 0, F.get(known, at))


def rank_percentiles(measured: DataFrame, metrics: list[str], by: tuple[str, ...] = (), points: tuple[int, ...] = (50, 90)) -> DataFrame:
    """``<by>, metric, known, total, p50, p90`` of all metrics (and groups), exact for any number of rows.

    One pass over the rows counts the values of every metric by value.  Ranks are then looked for among distinct durations, all at once, with
    running sums in two steps: over ranges of values, and in the range that holds the rank.
    """
    keys = [*by, "metric"]
    stacked = measured.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select(*by, "x.*")
    counts = durable.written(stacked.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("known"), F.sum("n").alias("total"))
    ranges = counts.filter("v is not null").withColumn("r", F.shiftright("v", 10))
    over = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy(*keys, "r").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(over), F.lit(0))).drop("m").alias("b")
    inside = Window.partitionBy(*keys, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("upto", F.sum("n").over(inside)).alias("a")
    placed = placed.join(before, [*equal_columns("a", "b", keys), F.col("a.r") == F.col("b.r")]).select(*[F.col(f"a.{k}").alias(k) for k in keys], "v", (F.col("before") + F.col("upto")).alias("upto"))
    joined = totals.alias("t").join(placed.alias("p"), equal_columns("t", "p", keys), "left")
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("known") - 1) * p / 100), F.col("v"))).alias(f"p{p}") for p in points]
    return joined.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], "known", "total").agg(*picks)


def equal_columns(a: str, b: str, keys: list[str]) -> list[Column]:
    """Join conditions on keys that may be null."""
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def known_of_total(measured: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, known, total`` for each column, in one pass."""
    sums = measured.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("known"), "total") for c in columns])).alias("x")).select("x.*")


def reconciles(buckets: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: whether counts add up to the total and the ids are all incidents, once each."""
    b = buckets.select("count", F.explode("incident_ids").alias("id"))
    sums = buckets.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"))
    ids = b.agg(F.count("id").alias("n_ids"), F.count_distinct("id").alias("distinct_ids"))
    total = incidents.agg(F.count(F.lit(1)).alias("total"))
    out = sums.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(total))  # one row each
    return out.withColumn("ok", (F.col("count_sum") == F.col("total")) & (F.col("n_ids") == F.col("total")) & (F.col("distinct_ids") == F.col("total")))


def data_hash(incidents: DataFrame) -> DataFrame:
    """SHA-256 of the ids, one after the other in canonical order.  Such a hash has no parallel form: the sorted ids stream
    through the driver, a partition at a time."""
    digest = hashlib.sha256()
    for r in incidents.orderBy(*inc.canonical_order()).select(F.col("id").cast("string").alias("id")).toLocalIterator():
        digest.update(r["id"].encode())
    return incidents.sparkSession.createDataFrame([(digest.hexdigest(),)], "data_hash string")


def content_hash(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``content_hash, rows``: 256 bits that change with any value of any row, and not with the rows' order.

    The four 64-bit parts of each row's SHA-256 are added up apart, modulo 2^64, so tasks and table versions add up too, and repeated rows count.
    """
    digest = rows.select(F.sha2(F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda k: F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = digest.agg(*[F.coalesce(F.sum(part(k)), F.lit(0)).alias(f"s{k}") for k in range(4)], F.count(F.lit(1)).alias("rows"))
    wrapped = lambda k: F.lpad(F.lower(F.conv((F.col(f"s{k}") % F.lit(str(2**64)).cast("decimal(38,0)")).cast("string"), 10, 16)), 16, "0")
    return sums.select(F.concat(*[wrapped(k) for k in range(4)]).alias("content_hash"), "rows")


def summaries(incidents: DataFrame, version: int = 2) -> DataFrame:
    """The dashboard's incident list, in canonical order."""
    m = with_warnings(inc.with_metrics(incidents))
    v1 = ["id", "external_id", "title", "severity", "mttr_seconds", "warning_count"]
    v2 = ["id", "external_id", "title", "severity", "detection_source", "vendor", "service", "impact_pct", "service_health_pct", "mttr_seconds", "warning_count"]
    return m.orderBy(*inc.canonical_order()).select(*(v1 if version == 1 else v2))
