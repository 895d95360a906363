"""Scans, orders, pages, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.errors import TidelogError
from tidelog.functions import incident as inc

LAST = "9999-12-31T23:59:59Z"
PAGE, PAGE_MAX = 50, 100


def canonical(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(*inc.canonical_order())


def timeline_of(events: DataFrame, incident_id: int) -> DataFrame:
    """One incident's events: by time, unknown times last."""
    return events.filter(F.col("incident_id") == incident_id).orderBy(F.col("ts").asc_nulls_last(), "id")


def timeline(events: DataFrame) -> DataFrame:
    """All events: by incident, time and id, with the stand-ins for unknown ones."""
    return events.orderBy(F.coalesce("incident_id", F.lit(0)), F.coalesce("ts", F.lit(LAST)), "id")


def artifacts_of(artifacts: DataFrame, incident_id: int) -> DataFrame:
    return artifacts.filter(F.col("incident_id") == incident_id).orderBy("created_at", "id")


SORTS = {"created_at": "start_ts", "start_ts": "start_ts", "title": "title", None: "id", "id": "id"}


def _check_page(limit: int, offset: int, sort: str | None) -> None:
    if not 1 <= limit <= PAGE_MAX or offset < 0 or sort not in SORTS:
        raise TidelogError("INVALID_PAGINATION", "Pagination is out of range", f"limit={limit}; offset={offset}; sort={sort}")


def _page_order(sort: str | None, descending: bool) -> list[Column]:
    key = F.col(SORTS[sort])
    return [key.desc_nulls_last() if descending else key.asc_nulls_first()] + ([] if SORTS[sort] == "id" else [F.col("id")])


def _envelope(total: int, limit: int, offset: int) -> dict:
    return {"total": total, "limit": limit, "offset": offset, "has_next": offset + limit < total, "has_prev": offset > 0}


def page(frame: DataFrame, limit: int = PAGE, offset: int = 0, sort: str | None = None, descending: bool = False) -> tuple[DataFrame, dict]:
    """A page and its envelope.  Sorting by ``created_at`` means by ``start_ts``.  For many or deep pages of one frame there is ``Pages``."""
    _check_page(limit, offset, sort)
    return frame.orderBy(*_page_order(sort, descending)).offset(offset).limit(limit), _envelope(frame.count(), limit, offset)


#: Rows of one range of a page index.
RANGE_ROWS = 50_000


class Pages:
    """Pages of a frame in one order, however deep, each read from the range that holds it.

    The frame is dealt into ranges of the order once and written, a folder for each; the driver keeps how many rows each has.  A page
    starts in the range that the counts before it tell, and reads that one, or two where it goes over an edge.
    """

    def __init__(self, frame: DataFrame, sort: str | None = None, descending: bool = False, range_rows: int = RANGE_ROWS):
        _check_page(PAGE, 0, sort)
        self.spark, self.schema, self.order, self.sort = frame.sparkSession, frame.schema, _page_order(sort, descending), sort
        n = max(1, -(-frame.count() // range_rows))
        dealt = frame.repartitionByRange(n, *self.order).withColumn("__range", F.spark_partition_id())
        self.folder = durable.written_by(dealt, "__range")
        sizes = self.spark.read.schema(dealt.schema).parquet(self.folder).groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()  # a row for each range
        self.ranges = [(r["__range"], r["n"]) for r in sizes]
        self.total = sum(n for _, n in self.ranges)

    def page(self, limit: int = PAGE, offset: int = 0) -> tuple[DataFrame, dict]:
        _check_page(limit, offset, self.sort)
        before, first, held = 0, 0, []
        for name, n in self.ranges:
            if before + n > offset and before < offset + limit:
                first = first if held else before
                held.append(f"{self.folder}/__range={name}")
            before += n
        if not held:
            return self.spark.createDataFrame([], self.schema), _envelope(self.total, limit, offset)
        rows = self.spark.read.schema(self.schema).parquet(*held).orderBy(*self.order).offset(offset - first).limit(limit)
        return rows, _envelope(self.total, limit, offset)


def lookup(frame: DataFrame, column: str, value: object) -> DataFrame:
    return frame.filter(F.col(column) == F.lit(value))


def in_ids(frame: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is among ids (drill-down)."""
    return frame.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def first_of(frame: DataFrame, key: str | list[str], order: list[Column], exempt_null: bool = True) -> DataFrame:
    """The first row of each key; with exempt_null (for a key of one column), rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = frame.withColumn("__rn", F.row_number().over(w))
    keep = (F.col("__rn") == 1) | (F.col(key).isNull() if exempt_null else F.lit(False))
    return ranked.filter(keep).drop("__rn")


def ranked(frame: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """frame with its rank (1, 2, ...) in an order without ties, and no task that sees all rows: ranges of the order are sorted
    each for itself, and a rank is the place in the range and the rows of the ranges before.  The ranges are written, as they
    must not move between their count and their use."""
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable.written(dealt.withColumns({"__at": F.monotonically_increasing_id(), "__range": F.spark_partition_id()}))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)  # the low bits count the rows of a partition
    return placed.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + inside + 1).drop("__range", "__at", "__before")


def _distinct_in_order(values: DataFrame, column: str) -> DataFrame:
    """``value, rn``: distinct non-blank values with their place in order, from 1."""
    return ranked(values.select(F.col(column).alias("value")).filter(F.trim("value") != "").distinct(), [F.col("value")])


def numbered(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """``value, pseudonym``: distinct non-blank values, numbered in order from 001."""
    return _distinct_in_order(values, column).select("value", F.format_string("%s_%03d", F.lit(prefix), "rn").alias("pseudonym"))


#: Letters of a name at most: names of 13 letters are more than a long counts.
LETTERS = 13


def letters(n: Column) -> Column:
    """1, 2, ... as A..Z, AA, AB, ..., ZZ, AAA, ...: numbers in base 26 without a zero."""
    start = F.struct(F.lit("").alias("text"), n.cast("long").alias("rest"))

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        more = F.struct(F.concat(F.char((rest - 1) % 26 + 65), state["text"]).alias("text"), F.call_function("div", rest - 1, F.lit(26).cast("long")).alias("rest"))
        return F.when(rest > 0, more).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(LETTERS)), start, step, lambda state: state["text"])


def lettered(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """As ``numbered`` with letters A..Z; from the 27th on, AA, AB, ..., and so on with more letters."""
    return _distinct_in_order(values, column).select("value", F.concat(F.lit(f"{prefix}_"), letters(F.col("rn"))).alias("pseudonym"))


def incident_keys(incidents: DataFrame) -> DataFrame:
    """``id, incident_key``: INC_001, ... in canonical order."""
    keys = ranked(incidents.select("id", "external_id", "title"), inc.canonical_order())
    return keys.select("id", F.format_string("INC_%03d", "rn").alias("incident_key"))


def detail(incidents: DataFrame, artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Each incident with its artifacts and timeline as arrays, and both kinds of warnings in order of code."""
    by = lambda f, order: f.filter("incident_id is not null").groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
    arts = by(artifacts, ["created_at", "id", "kind", "sha256"]).select(F.col("incident_id").alias("id"), F.col("x").alias("artifacts"))
    last = F.coalesce("ts", F.lit("~")).alias("sort_ts")
    evs = by(events, [last, "id", "ts", "text"]).select(F.col("incident_id").alias("id"), F.col("x").alias("timeline"))
    both = F.concat(
        F.transform(inc.validation_warnings(), lambda w, i: F.struct(w["code"].alias("code"), F.lit(0).alias("origin"), i.alias("at"), w.alias("w"))),
        F.transform(inc.metric_warnings(), lambda w, i: F.struct(w["code"].alias("code"), F.lit(1).alias("origin"), i.alias("at"), w.alias("w"))),
    )
    merged = F.transform(F.array_sort(F.transform(both, lambda x: F.struct(x["code"].alias("code"), x["origin"].alias("origin"), x["at"].alias("at"), x["w"].alias("w")))), lambda x: x["w"])
    return incidents.join(arts, "id", "left").join(evs, "id", "left").withColumn("warnings", merged)


def code_counts(codes: DataFrame) -> DataFrame:
    return codes.groupBy("incident_key", "code").agg(F.count(F.lit(1)).alias("n"))


def multiset_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``code, missing, extra``: what expected has more of, and actual, summed over keys."""
    missing = expected.select("incident_key", "code").exceptAll(actual.select("incident_key", "code")).groupBy("code").agg(F.count(F.lit(1)).alias("missing"))
    extra = actual.select("incident_key", "code").exceptAll(expected.select("incident_key", "code")).groupBy("code").agg(F.count(F.lit(1)).alias("extra"))
    return missing.join(extra, "code", "full").select("code", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra"))


def top_codes(counted: DataFrame, k: int = 5) -> DataFrame:
    """One row: the k most frequent codes as ``CODExN``, joined by commas."""
    top = counted.orderBy(F.desc("n"), "code").limit(k)
    return top.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), lambda x: F.concat(x["code"], F.lit("x"), (-x["m"]).cast("string")))).alias("top_codes"))


def next_ids(new: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """New rows with ids from the largest existing one on, in the given order."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))  # one row
    return ranked(new, order, "__rn").crossJoin(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("__rn")).drop("__top", "__rn")
