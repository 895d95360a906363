"""Imports of batches whose rows depend on each other, against a table that takes one row after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.plans import importing
from tidelog.schema import INCIDENT
from tidelog.sources import issues_csv

TIMES = ("start_ts", "first_observed_ts", "ack_ts")
FIELDS = ("title", "severity", "external_id", *TIMES)


def batch(spark, rows):
    """rows: (external_id, title, severity, three moments)."""
    cells = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, external_id string, title string, severity string, start_ts string, first_observed_ts string, ack_ts string").repartition(3)
    return issues_csv.staged(cells.withColumn("bad", F.lit(False)).withColumns({f: F.lit(None).cast("string") for f in issues_csv.FIELDS if f not in FIELDS}))


def one_by_one(table, rows):
    """table: list of incidents (dicts), changed in place; the outcome of each row."""
    mark = lambda x: (x["title"].lower(), *(x[t] for t in TIMES))
    ids, marks, out = set(), set(), []
    for n, values in enumerate(rows):
        row = dict(zip(("external_id", "title", "severity", *TIMES), values, strict=True))
        if row["title"] is None:
            out.append((n, "skipped"))
            continue
        if row["external_id"] is not None and row["external_id"] in ids:
            out.append((n, "skipped"))
            continue
        ids.add(row["external_id"])
        if mark(row) in marks:
            out.append((n, "skipped"))
            continue
        marks.add(mark(row))
        by_id = row["external_id"] is not None
        found = next((x for x in table if (x["external_id"] == row["external_id"] if by_id else mark(x) == mark(row))), None)
        new = dict(row) if found is None else {k: found[k] if row[k] is None else row[k] for k in row}
        if found is not None and new == found:
            out.append((n, "skipped"))
        elif any(mark(x) == mark(new) for x in table if x is not found):
            out.append((n, "skipped"))
        elif found is None:
            table.append(new)
            out.append((n, "inserted"))
        else:
            found.update(new)
            out.append((n, "updated"))
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    moment = lambda: r.choice([None, None, "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"])
    return [(r.choice([None, *[f"E{i}" for i in range(n // 2)]]), r.choice(["A", "B", "a", None] if r.random() < 0.2 else ["A", "B"]), r.choice([None, "SEV1", "SEV2"]), moment(), moment(), moment()) for _ in range(n)]


def check(spark, batches):
    table, stored = [], spark.createDataFrame([], INCIDENT)
    depended = False
    for rows in batches:
        expected = one_by_one(table, rows)
        result = importing.upsert(batch(spark, rows), stored)
        assert sorted(map(tuple, result.outcomes.select("row", "outcome").collect())) == expected
        stored = spark.createDataFrame(result.incidents.collect(), INCIDENT)
        got = [tuple(r) for r in stored.orderBy("id").select("external_id", "title", "severity", *TIMES).collect()]
        assert got == [tuple(x[k] for k in ("external_id", "title", "severity", *TIMES)) for x in table]
        assert [r.id for r in stored.orderBy("id").collect()] == list(range(1, len(table) + 1))
        assert stored.groupBy("fingerprint").count().filter("count > 1").isEmpty()
        depended |= not result.outcomes.filter(F.col("reason").isin(importing.CONFLICT_ON_INSERT, importing.CONFLICT_ON_UPDATE)).isEmpty()
    return depended


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, seed):
    check(spark, [rows_of(seed * 10 + k, 14) for k in range(2)])


D1, D2 = "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"


def test_a_fingerprint_left_by_an_earlier_row_is_free_and_a_taken_one_is_not(spark):
    first = [("E1", "A", None, D1, None, None), ("E2", "B", None, D2, None, None)]
    # E1 leaves (A, D1); E3 takes it; E2's update into what E1 has now fails; a row without id finds E3's incident and changes it
    assert check(spark, [first, [("E1", "A", None, D2, None, None), ("E3", "A", None, D1, None, None), ("E2", "A", None, None, None, None), (None, "A", "SEV1", D1, None, None)]])


def test_two_rows_that_become_equal_only_by_merging(spark):
    first = [("E1", "A", None, D1, None, None), ("E2", "B", None, D1, None, None)]
    # different rows, equal once the stored start is merged in: the first has it, the second is a conflict
    assert check(spark, [first, [("E1", "C", None, None, D1, None), ("E2", "C", None, None, D1, None)], [("E2", "C", None, D1, D1, None), ("E1", "D", None, None, None, None), ("E2", "C", None, None, None, None)]])


def test_a_chain_of_rows_each_waiting_for_the_one_before(spark):
    n = 5
    first = [(f"E{i}", f"T{i}", None, D1, None, None) for i in range(n)]
    # each takes the title that the one before it has just left
    forward = [(f"E{i}", f"T{i - 1}" if i else "new", None, None, None, None) for i in range(n)]
    assert not check(spark, [first, forward])
    # in the other order each still finds it taken, but for the last
    assert check(spark, [first, forward[::-1]])
