"""A whole review through the one entry."""

import pytest

from tests.test_story import MAPPING, STORY
from tidelog.errors import TidelogError
from tidelog.plans import drafting
from tidelog.plans.session import RECENT, Session


def vectors_of(texts):
    return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


def test_review(spark, tmp_path):
    (tmp_path / "a.csv").write_text(STORY)
    s = Session(spark)
    with pytest.raises(TidelogError, match="WORKSPACE_NOT_FOUND"):
        s.report()
    s.create(str(tmp_path / "w"))
    assert s.preview_csv(str(tmp_path / "a.csv"), 2)[1][0][0] == "OPS-11"
    profile = s.workspace.put_profile("mine", MAPPING)
    assert s.import_csv(str(tmp_path / "a.csv"), profile)["inserted"] == 5
    warnings = s.ingest_transcript("2026-02-03T06:05:00Z ann: looking\nno time", "2026-02-08T00:00:00Z", incident_id=1)
    assert warnings.count() == 1 and len(s.incident(1).first()["timeline"]) == 2
    with pytest.raises(TidelogError, match="DB_NOT_FOUND"):
        s.incident(99)
    with pytest.raises(TidelogError, match="DEMO_NOT_EMPTY"):
        s.seed_demo()

    assert s.gate(True, 0)["missing"] == "AI_EVIDENCE_EMPTY" and s.gate(False, 0)["missing"] == "AI_MODEL_UNREACHABLE"
    s.export_sanitized(str(tmp_path / "x"), "2026-03-01T00:00:00Z", "1")
    export = s.add_source("sanitized_export", "directory", "export", "t", path=str(tmp_path / "x"))
    s.add_source("freeform_text", "paste", "notes", "t", text="We met on Monday.")
    assert s.gate(True, 0)["missing"] == "AI_INDEX_NOT_READY" and s.build_chunks() == 6
    rows, env = s.chunks(4, 4)
    assert rows.count() == 2 and env["total"] == 6
    status = s.build_index(vectors_of, "embedder", "t")
    assert status == s.index_status() and status.chunk_count == 6 and s.gate(True, 0) == {"can_search": True, "can_draft": False, "missing": "AI_CITATION_REQUIRED"}
    hit = s.ask(vectors_of, "Which incidents?", 3, [export]).first()
    assert hit["source_id"] == export and hit["snippet"].startswith("Incident Key: INC_")
    assert s.context(hit["chunk_id"], 1).count() in (2, 3) and s.chunk(hit["chunk_id"]).count() == 1

    first = s.write_draft([hit["chunk_id"]], "exec_summary", "2026-Q1", "short", lambda p: f"- a claim [[chunk:{hit['chunk_id']}]]", "writer", "2026-03-02T00:00:00Z")
    second = s.write_draft([hit["chunk_id"]], "exec_summary", "2026-Q1", "shorter", lambda p: f"- less [[chunk:{hit['chunk_id']}]]", "writer", "2026-03-03T00:00:00Z", parent=first)
    assert s.draft(second).first()["revision_number"] == 2 and [r["id"] for r in s.drafts("2026-Q1").collect()] == [second, first]
    assert len(s.draft(first).first()["model_params_hash"]) == 64

    (tmp_path / "art" / "sub").mkdir(parents=True)
    (tmp_path / "art" / "sub" / "log.txt").write_text("line")
    manifest = s.backup(str(tmp_path / "b"), "t", "1", str(tmp_path / "art"))
    assert [f["filename"] for f in manifest["files"]] == ["sub/log.txt"]
    w = s.restore(str(tmp_path / "b"), str(tmp_path / "w2"))
    assert w.table("drafts").count() == 2 and (tmp_path / "w2" / "files" / "sub" / "log.txt").read_text() == "line"
    (tmp_path / "b" / "files" / "sub" / "log.txt").write_text("other")
    (tmp_path / "b" / "files" / "sub" / ".log.txt.crc").unlink(missing_ok=True)
    with pytest.raises(TidelogError, match="RESTORE_HASH_MISMATCH"):
        s.restore(str(tmp_path / "b"), str(tmp_path / "w3"))

    s.create(str(tmp_path / "w4"))
    assert s.import_sanitized(str(tmp_path / "x"))[0]["details"] == "incidents=5"
    whole = s.load_all(str(tmp_path / "w2"))
    assert whole["dashboard"]["incident_count"] == 5 and whole["report"].startswith("# ") and whole["incidents"].count() == 5 and whole["validation"].count() == 1
    assert [x.rsplit("/", 1)[1] for x in s.recent] == ["w2", "w4", "w"]


def test_recent_list(spark, tmp_path):
    s = Session(spark, tuple(f"/old{i}" for i in range(RECENT)))
    w = s.create(str(tmp_path / "w"))
    assert s.recent[0] == w.root and len(s.recent) == RECENT and f"/old{RECENT - 1}" not in s.recent


def test_prompts_and_models(spark):
    for section in drafting.TASKS:
        text = drafting.prompt(section, "2026-Q1", "be brief", "[[chunk:c]] ...")
        assert "2026-Q1" in text and "be brief" in text and text.endswith("[[chunk:c]] ...") and "do not calculate" in text
    assert drafting.embedding_models(["a-embed", "b"]) == ["a-embed"] and drafting.drafting_models(["a-embed", "b"]) == ["b"]
    assert drafting.ladder(None, 1, 1, None, 1) == {"can_search": False, "can_draft": False, "missing": "AI_CITATION_REQUIRED"}
