"""Bitmaps of bucket members against sets of ids."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog import queries
from tidelog.operators import analytics as an
from tidelog.operators import membership as ms

EDGES = [-100_000, -32_769, -32_768, -32_767, -1, 0, 1, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 10**12]


def made(spark, ids):
    return ms.build(spark.createDataFrame([(i,) for i in ids], "id long"))


def held(sets):
    rows = [r.id for r in ms.ids(sets).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_sets(spark):
    r = random.Random(1)
    a, b = [{*r.sample(EDGES, 11), *(r.randrange(-70_000, 70_000) for _ in range(300))} for _ in range(2)]
    sa, sb = made(spark, [*a, None, 5, 5]), made(spark, b)
    a.add(5)
    assert held(sa) == a and held(ms.union(sa, sb)) == a | b and held(ms.intersect(sa, sb)) == a & b and held(ms.minus(sa, sb)) == a - b
    assert held(ms.minus(sa, sa)) == set() and held(ms.intersect(sa, made(spark, []))) == set()
    frame = spark.createDataFrame([(i, str(i)) for i in range(-200, 200)] + [(None, "x")], "id long, name string")
    assert {x.id for x in ms.rows_of(frame, sa).collect()} == {i for i in range(-200, 200) if i in a}
    assert ms.counts(sa).first()["count"] == len(a)


def test_buckets_reconcile_and_overlaps_do_not(spark):
    rows = spark.createDataFrame([(i, f"v{i % 11}" if i % 11 else "OTHER") for i in range(1, 400)] + [(40_000, None)], "id long, vendor string")
    top = ms.top_by_count(rows, "vendor")
    assert ms.reconciles(top, rows).first().asDict() == {"count_sum": 400, "distinct_ids": 400, "total": 400, "ok": True}
    assert not ms.reconciles(top.unionByName(top.limit(1)), rows).first()["ok"]
    assert not ms.reconciles(top.filter("not is_overflow"), rows).first()["ok"]
    assert ms.reconciles(top.limit(0), rows.limit(0)).first()["ok"]


def test_reconciliation_holds_counts_and_listed_ids_against_the_rows(spark):
    made = [(i, f"v{i % 11}" if i % 11 else "OTHER") for i in range(1, 400)] + [(40_000, None)]
    rows = spark.createDataFrame(made, "id long, vendor string")
    counted, top = an.top_by_count(rows, "vendor", with_ids=False), ms.top_by_count(rows, "vendor")
    got = lambda *frames: ms.reconciliation(*frames).first().asDict()
    whole = {"count_sum": 400, "n_ids": 400, "distinct_ids": 400, "total": 400, "ok": True}
    assert got(counted, top, rows) == whole and list(got(counted, top, rows)) == list(whole)
    assert got(counted.withColumn("count", F.col("count") + 1), top, rows) == whole | {"count_sum": 409, "ok": False}
    extra = top.filter("label = 'v1'")
    n = extra.agg(F.sum("listed")).first()[0]
    assert got(counted, top.unionByName(extra), rows) == whole | {"n_ids": 400 + n, "ok": False}
    assert got(counted, top.filter("label != 'v1'"), rows) == whole | {"n_ids": 400 - n, "distinct_ids": 400 - n, "ok": False}
    # an id that is repeated in its bucket or in another, and one that is missing
    for odd, sizes in (((1, "v1"), (401, 401, 400, 401)), ((1, "v2"), (401, 401, 400, 401)), ((None, "v1"), (401, 400, 400, 401))):
        more = spark.createDataFrame([*made, odd], "id long, vendor string")
        assert tuple(got(an.top_by_count(more, "vendor", with_ids=False), ms.top_by_count(more, "vendor"), more).values()) == (*sizes, False)
    # as many ids, but not the table's
    other = rows.withColumn("id", F.col("id") + 1)
    assert got(counted, ms.top_by_count(other, "vendor"), rows) == whole | {"ok": False}
    none = rows.limit(0)
    assert got(an.top_by_count(none, "vendor", with_ids=False), ms.top_by_count(none, "vendor"), none) == dict.fromkeys(whole, 0) | {"ok": True}


def test_query_reconciles_listed_ids_of_a_table_that_repeats_some(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    # users 1 and 13 have one vendor and the same event ids; user 14 has them too, with another vendor
    events = [(k if u in (13, 14) else 1000 * (u - 1) + k, at + datetime.timedelta(minutes=k), u, "view", 1.0, "{}") for u in range(1, 40) for k in range(1, 14)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    cursor = duck.execute(queries.ORACLE["bucket_reconciliation"])
    expected = dict(zip([c[0] for c in cursor.description], cursor.fetchone(), strict=True))
    assert expected == {"count_sum": 117, "n_ids": 117, "distinct_ids": 111, "total": 117, "ok": True}
    # the SQL takes unique ids for granted, the check finds that they aren't
    assert queries.QUERIES["bucket_reconciliation"](spark, str(tmp_path)).first().asDict() == expected | {"ok": False}


@pytest.mark.parametrize("pain", [False, True])
def test_members_are_those_of_the_arrays(spark, pain):
    rows = spark.createDataFrame([(i * 37, f"v{i % 14}" if i % 5 else None if i % 2 else "OTHER", 2**62 if i % 3 == 0 else i if i % 4 else None) for i in range(1, 300)], "id long, vendor string, pain long")
    arrays = an.top_by_pain(rows, "vendor") if pain else an.top_by_count(rows, "vendor")
    sets = ms.top_by_pain(rows, "vendor") if pain else ms.top_by_count(rows, "vendor")
    same = ["label", "is_overflow", "count", *(["pain_sum", "pain_known_count"] if pain else [])]
    expected = {tuple(r[c] for c in same): set(r.incident_ids) for r in arrays.collect()}
    got = {}
    for r in ms.ids(sets.select(*same, "block", "bits")).collect():
        got.setdefault(tuple(r[c] for c in same), set()).add(r.id)
    assert got == expected
    plain = an.top_by_pain(rows, "vendor", with_ids=False) if pain else an.top_by_count(rows, "vendor", with_ids=False)
    assert [tuple(r[c] for c in same) for r in plain.collect()] == list(expected) and "incident_ids" not in plain.columns


def test_crossing(spark):
    rows = [(i, f"a{i % 3}", f"b{i % 5 if i % 3 else 0}") for i in range(-40_000, 40_000, 7)]
    f = spark.createDataFrame(rows, "id long, a string, b string")
    got = {(r.a_label, r.b_label): r["count"] for r in ms.crossed(ms.build(f, F.col("a").alias("label")), ms.build(f, F.col("b").alias("label"))).collect()}
    expected = {}
    for _, a, b in rows:
        expected[a, b] = expected.get((a, b), 0) + 1
    assert got == expected
