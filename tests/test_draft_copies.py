"""Drafts of one content under several ids: turns with the same words, as larger tables hold them."""

import duckdb
import pytest

from tests.test_oracle import norm, same
from tidelog import queries
from tidelog.errors import TidelogError
from tidelog.operators import drafts as dr
from tidelog.schema import DRAFT

#: (conv_id, turn, text): conversations 308 apart give drafts of one content; two pairs of turns share an id, one of them an id divisible by 3.
TURNS = [(c, t, f"text {t}") for c in (1, 2, 309, 310, 617, 618) for t in range(3)] + [(3, 1004, "a"), (4, 4, "b"), (3, 1005, "a"), (4, 5, "b"), (11, 0, "not cited")]


@pytest.fixture
def turns(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], text) for c, t, text in TURNS]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return tmp_path


def as_sql(spark, turns, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{turns}/conversations.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(turns))
    rows = [tuple(norm(x) for x in r) for r in df.collect()]
    same(rows, df.columns, duck.execute(queries.ORACLE[name]))
    return rows


def test_created(spark, turns):
    rows = as_sql(spark, turns, "draft_created")
    assert len(rows) == len(TURNS) - 1 and len({h for _, h in rows}) == 6 + 4


def test_repeats(spark, turns):
    # of the turns whose id no 3 divides one shares its content with a stored one, or with another, or its id with a turn of other words
    rows = as_sql(spark, turns, "draft_repeats")
    assert len(rows) == len([1 for c, t, _ in TURNS if c != 11 and (c * 1000 + t) % 3]) and len({h for _, h in rows}) < len(rows)


def test_known_by_id_and_hash(spark):
    frame = lambda *rows: spark.createDataFrame([(i, h, "2026-01-01T00:00:00Z") for i, h in rows], "id long, artifact_hash string, created_at string")
    new, there = frame((1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c")), frame((3, "c"), (9, "a"))
    got = lambda *by: sorted((r.id, r.artifact_hash) for r in dr.not_known(new, there, *by).collect())
    assert got() == [(2, "b")] and got(("id", "artifact_hash")) == [(1, "a"), (2, "a"), (2, "b")]


def test_copies_that_come_together(spark):
    row = dict.fromkeys(DRAFT.fieldNames()) | {"quarter_label": "Q", "section_type": "exec_summary", "draft_text": "x", "citation_chunk_ids": ["c"], "model_name": "m", "model_params_hash": "h", "prompt_template_version": "v1", "created_at": "2026-01-02T00:00:00Z"}
    new = spark.createDataFrame([row | {"id": i, "branch_label": f"b{i}"} for i in (9, 7, 8)] + [row | {"id": 10, "created_at": "2026-01-01T00:00:00Z"}], DRAFT)
    stored = dr.create(new, new.limit(0), copies=True)
    assert [(r.id, r.branch_label) for r in stored.orderBy("id").collect()] == [(1, None), (2, "b7"), (3, "b8"), (4, "b9")]
    for again in (new, new.filter("id = 7")):
        with pytest.raises(TidelogError, match="DB_AI_DRAFT_CREATE_FAILED"):
            dr.create(again, stored, copies=True)
    with pytest.raises(TidelogError, match="DB_AI_DRAFT_CREATE_FAILED"):
        dr.create(new, new.limit(0))
