"""Commits of several writers, parts of keyed tables, and a dashboard that follows edits."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tests.test_story import MAPPING, STORY
from tidelog.errors import TidelogError
from tidelog.operators import drafts as dr
from tidelog.plans.session import Session
from tidelog.schema import CHUNK, DRAFT, INCIDENT
from tidelog.sources.workspace import CONFLICT, Changed, Workspace


def profile(spark, n):
    return spark.createDataFrame([(n, f"p{n}", {"title": "T"})], "id long, name string, mapping map<string,string>")


def test_a_late_writer_meets_a_conflict_and_update_tries_again(spark, tmp_path):
    a = Workspace.create(spark, str(tmp_path / "w"))
    b = Workspace.open(spark, str(tmp_path / "w"))
    rows = b.table("profiles")
    a.append("profiles", profile(spark, 1))
    with pytest.raises(TidelogError, match=CONFLICT):
        b.replace("profiles", rows.unionByName(profile(spark, 2)))
    late = b.snapshot()
    made = {"profiles": late.table("profiles").unionByName(profile(spark, 2))}
    a.append("profiles", profile(spark, 3))
    with pytest.raises(TidelogError, match=CONFLICT):
        b.commit(late, made)
    tries = []

    def slow(at):
        tries.append(at.version)
        if len(tries) == 1:
            a.append("profiles", profile(spark, 4))
        return {"profiles": at.table("profiles").unionByName(profile(spark, 2))}

    b.update(slow)
    assert len(tries) == 2 and sorted(r.id for r in a.table("profiles").collect()) == [1, 2, 3, 4]


def test_writers_of_different_tables_do_not_wait_for_each_other(spark, tmp_path):
    a, b = Workspace.create(spark, str(tmp_path / "w")), Workspace.open(spark, str(tmp_path / "w"))
    base = b.snapshot()
    base.table("drafts")
    a.append("profiles", profile(spark, 1))
    b.commit(base, {"drafts": spark.createDataFrame([], DRAFT)})
    assert a.table("profiles").count() == 1
    # but what was read counts too
    base = b.snapshot()
    base.table("profiles")
    a.append("profiles", profile(spark, 2))
    with pytest.raises(TidelogError, match=CONFLICT):
        b.commit(base, {"drafts": spark.createDataFrame([], DRAFT)})


def test_many_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "w")
    Workspace.create(spark, root)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: Workspace.open(spark, root).update(lambda at: {"profiles": at.table("profiles").unionByName(profile(spark, n))}, attempts=20), range(6)))
    w = Workspace.open(spark, root)
    assert sorted(r.id for r in w.table("profiles").collect()) == list(range(6)) and w.latest() == 7
    assert [n for n in w.files.children("log") if not n.startswith(".")] == [f"{n:012d}.json" for n in range(1, 8)]


def draft(spark, text, created="2026-01-01T00:00:00Z"):
    row = dict.fromkeys(DRAFT.fieldNames()) | {"quarter_label": "Q", "section_type": "exec_summary", "draft_text": text, "citation_chunk_ids": ["c"], "model_name": "m", "model_params_hash": "h", "prompt_template_version": "v1", "created_at": created}
    return spark.createDataFrame([row], DRAFT)


def test_a_draft_is_stored_once(spark, tmp_path):
    a, b = Workspace.create(spark, str(tmp_path / "w")), Workspace.open(spark, str(tmp_path / "w"))
    a.update(lambda at: {"drafts": dr.create(draft(spark, "x"), at.table("drafts"))})
    for new in (draft(spark, "x"), draft(spark, "y").unionByName(draft(spark, "y"))):
        with pytest.raises(TidelogError, match="DB_AI_DRAFT_CREATE_FAILED"):
            dr.create(new, a.table("drafts"))
    raced = []

    def slow(at):
        if not raced:
            raced.append(a.update(lambda at: {"drafts": dr.create(draft(spark, "z"), at.table("drafts"))}))
        return {"drafts": dr.create(draft(spark, "z"), at.table("drafts"))}

    with pytest.raises(TidelogError, match="DB_AI_DRAFT_CREATE_FAILED"):
        b.update(slow)
    assert [r.id for r in b.table("drafts").orderBy("id").collect()] == [1, 2]
    once = dr.not_known(draft(spark, "q").unionByName(draft(spark, "q")).unionByName(draft(spark, "x")).withColumn("artifact_hash", dr.artifact_hash()), a.table("drafts"))
    assert once.count() == 1


def chunks(spark, source, n, text="t"):
    rows = [{"chunk_id": f"{source}-{i}", "source_id": source, "ordinal": i, "text": text, "text_sha256": "h", "token_count_est": 1, "meta": None} for i in range(n)]
    return spark.createDataFrame(rows, CHUNK)


def test_a_change_of_one_key_writes_its_part_only(spark, tmp_path):
    w = Workspace.create(spark, str(tmp_path / "w"))
    whole = chunks(spark, "s0", 3)
    for k in range(1, 12):
        whole = whole.unionByName(chunks(spark, f"s{k}", 3))
    w.replace("chunks", whole)
    before = w.snapshot().state["tables"]["chunks"]["parts"]
    base = w.snapshot()
    w.commit(base, {"chunks": Changed(chunks(spark, "s3", 5, "new"), spark.createDataFrame([("s3",)], "k string"))})
    after = w.snapshot().state["tables"]["chunks"]["parts"]
    assert len([p for p in after if after[p] != before.get(p)]) == 1 and base.reads == set()
    got = {r.source_id: (r.n, r.text) for r in w.table("chunks").groupBy("source_id").agg(F.count("*").alias("n"), F.max("text").alias("text")).collect()}
    assert got == {f"s{k}": (3, "t") for k in range(12)} | {"s3": (5, "new")}
    # rows under another key than told go to that key's part; a key without rows is removed
    w.commit(w.snapshot(), {"chunks": Changed(chunks(spark, "s99", 1), spark.createDataFrame([("s3",), (None,)], "k string"))})
    assert {r.source_id for r in w.table("chunks").select("source_id").distinct().collect()} == {f"s{k}" for k in range(12) if k != 3} | {"s99"}
    w.commit(w.snapshot(), {"chunks": Changed(w.table("chunks").limit(0), w.table("chunks").select("source_id"))})
    assert w.table("chunks").isEmpty() and w.table("incidents").schema == INCIDENT


def test_missing_schema_steps_are_asked_about(spark, tmp_path):
    root = str(tmp_path / "w")
    w = Workspace.create(spark, root)
    state = w.state(1)
    old = {"steps": state["steps"][:-1], "tables": {k: v for k, v in state["tables"].items() if k not in ("sources", "chunks", "vectors")}, "changed": []}
    (tmp_path / "w" / "log" / "000000000001.json").write_text(json.dumps(old))
    (tmp_path / "w" / "log" / ".000000000001.json.crc").unlink(missing_ok=True)
    with pytest.raises(TidelogError, match="WORKSPACE_MIGRATION_PENDING"):
        Session(spark).open(root)
    w = Session(spark).open(root, migrate=True)
    assert w.pending() == [] and w.table("chunks").isEmpty() and Workspace.open(spark, root).latest() == 2


def test_the_dashboard_follows_edits(spark, tmp_path):
    (tmp_path / "a.csv").write_text(STORY)
    s = Session(spark)
    s.create(str(tmp_path / "w"))
    s.import_csv(str(tmp_path / "a.csv"), MAPPING)
    first = s.dashboard(now=1.0)
    assert s.dashboard(now=2.0) is first
    parts = s.workspace.snapshot().state["tables"]["incidents"]["parts"]
    one = s.workspace.table("incidents").filter("external_id is not null").orderBy("id").first()
    (tmp_path / "b.csv").write_text(f"Key,Summary,Priority\n{one.external_id},{one.title},SEV9\n")
    assert s.import_csv(str(tmp_path / "b.csv"), {"external_id": "Key", "title": "Summary", "severity": "Priority"}) == {"inserted": 0, "updated": 1, "skipped": 0, "conflicts": 0, "warnings": 0}
    second = s.dashboard(now=3.0)
    assert "SEV9" in {r["severity"] for r in second["severity_counts"]} and second["incident_count"] == first["incident_count"]
    now = s.workspace.snapshot().state["tables"]["incidents"]["parts"]
    assert len([p for p in now if now[p] != parts.get(p)]) == 1


def chain(spark, n, first=0):
    return [dict.fromkeys(DRAFT.fieldNames()) | {"id": first + i, "parent_draft_id": first + i - 1 if i else None, "revision_number": i + 1} for i in range(n)]


def test_ancestors_of_a_deep_chain_and_rings(spark):
    rows = chain(spark, 10_000)
    ring = [dict.fromkeys(DRAFT.fieldNames()) | {"id": 20_000 + i, "parent_draft_id": 20_000 + (i + 1) % 3} for i in range(3)]
    into = [dict.fromkeys(DRAFT.fieldNames()) | {"id": 20_010, "parent_draft_id": 20_000}, dict.fromkeys(DRAFT.fieldNames()) | {"id": 20_011, "parent_draft_id": 99_999}]
    drafts = spark.createDataFrame(rows + ring + into, DRAFT)
    got = dr.ancestors(drafts, spark.createDataFrame([(9_999,), (3,), (20_000,), (20_011,)], "id long")).orderBy("id", "position").collect()
    assert [tuple(r) for r in got] == [(3, i, i) for i in range(4)] + [(9_999, i, i) for i in range(10_000)]
    assert sorted((r.id, r.code) for r in dr.rings(drafts).collect()) == [(i, "DB_AI_DRAFT_RING") for i in (20_000, 20_001, 20_002, 20_010)]


def test_siblings_in_order(spark):
    rows = [dict.fromkeys(DRAFT.fieldNames()) | {"id": i, "parent_draft_id": p, "revision_number": v} for i, p, v in ((1, None, 1), (2, 1, 3), (3, 1, 2), (4, 1, 2), (5, 9, 1))]
    got = dr.siblings(spark.createDataFrame(rows, DRAFT)).orderBy("id", "position").collect()
    assert [tuple(r) for r in got] == [(2, 3, 1), (2, 4, 2), (3, 4, 1), (3, 2, 2), (4, 3, 1), (4, 2, 2)]
