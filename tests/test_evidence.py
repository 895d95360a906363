import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.errors import TidelogError
from tidelog.operators import drafts as dr
from tidelog.operators import evidence as ev
from tidelog.operators import tables
from tidelog.plans import drafting, sanitizing
from tidelog.schema import DRAFT, INCIDENT, TIMELINE
from tidelog.sources import transcripts as tr
from tidelog.sources.workspace import Files
from tidelog.streaming import timeline


def test_transcripts(spark):
    rows = [
        ("lines", "2026-01-05T12:00:00Z - ann: hello: there\n2026-01-05T12:01:00+01:00 bob: hi\nNo timestamp here, should warn but still ingest as text.\n"),
        ("json", '[{"type":"message","user":"U1","text":"a","ts":"1700000000.000100"},5,{"text":" "},{"username":"x","text":"b"}]'),
        ("plain", "ann: hello\r\nnothing\n"),
        ("empty", ""),
    ]
    t = spark.createDataFrame(rows, "source_id string, text string")
    forms = {r["source_id"]: (r["detected_format"], r["message_count"], len(r["warnings"])) for r in tr.preview(t).collect()}
    assert forms == {"lines": ("line_rfc3339", 3, 0), "json": ("slack_json_export", 4, 0), "plain": ("raw_lines", 2, 1), "empty": ("raw_lines", 0, 1)}
    got = {(r["source_id"], r["idx"]): (r["ts"], r["author"], r["text"], r["warning"] and r["warning"]["code"]) for r in tr.events(t).collect()}
    assert got["lines", 0] == ("2026-01-05T12:00:00Z", "ann", "hello: there", None)
    assert got["lines", 1] == ("2026-01-05T11:01:00Z", "bob", "hi", None)
    assert got["lines", 2][0] is None and got["lines", 2][1] is None and got["lines", 2][3] == "INGEST_SLACK_TS_UNKNOWN"
    assert got["json", 0] == ("2023-11-14T22:13:20.0001Z", "U1", "a", None)
    assert got["json", 1][2:] == (None, "INGEST_SLACK_JSON_ROW_SKIPPED") and got["json", 3][3] == "INGEST_SLACK_TS_UNKNOWN"
    assert ("json", 2) not in got and got["plain", 1] == (None, None, "nothing", None)


def test_chunks_and_context(spark):
    text = "\n\n".join([c * 900 for c in "abc"] + ["d" * 2000, "e", "f"])
    s = spark.createDataFrame([("s", text), ("none", None), ("blank", "\n\n ")], "source_id string, text string")
    c = ev.chunks(s)
    got = [r["text"] for r in c.orderBy("ordinal").collect()]
    assert got == ["a" * 900, "b" * 900, "c" * 900, "d" * 2000, "e\n\nf"]
    mid = c.filter("ordinal = 2")
    assert sorted(r["distance"] for r in ev.context(c, mid, 1).collect()) == [-1, 0, 1]
    assert sorted(r["distance"] for r in ev.context(c, mid, 50).collect()) == [-2, -1, 0, 1, 2]
    with pytest.raises(TidelogError):
        ev.context(c, mid, 51)


def test_snippets_cut_whole_characters(spark):
    t = spark.createDataFrame([("é" * 200,), (" short ",), ("x" * 281,)], "t string")
    assert [r[0] for r in t.select(ev.snippet(F.col("t"))).collect()] == ["é" * 140 + "...", "short", "x" * 280 + "..."]


def test_search(spark):
    v = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "s", [2.0, 0.0]), ("c", "t", [0.0, 1.0]), ("z", "t", [0.0, 0.0])], "chunk_id string, source_id string, embedding array<float>")
    assert [(r["chunk_id"], r["score"]) for r in ev.search(v, [3.0, 0.0], 0).collect()] == [("a", 1.0)]
    assert [r["chunk_id"] for r in ev.search(v, [3.0, 0.0], 9).collect()] == ["a", "b", "c"]
    assert ev.search(v, [0.0, 0.0], 3).count() == 0


def test_index_keeps_unchanged(spark):
    c = spark.createDataFrame([("a", "1", "xx"), ("b", "2", "yyy")], "chunk_id string, text_sha256 string, text string")
    old = spark.createDataFrame([("a", "1", [9.0]), ("b", "old", [9.0]), ("gone", "3", [9.0])], "chunk_id string, text_sha256 string, embedding array<float>")
    got = {r["chunk_id"]: r["embedding"] for r in ev.build_index(c, old, lambda xs: [[float(len(x))] for x in xs]).collect()}
    assert got == {"a": [9.0], "b": [3.0]}


def test_drafting(spark):
    c = spark.createDataFrame([("c1", "s", 0, "one", "h1"), ("c2", "s", 1, "two", "h2")], "chunk_id string, source_id string, ordinal int, text string, text_sha256 string")
    seen = []
    out = drafting.draft(c, ["c2", "c1", "c2"], "action_plan_next_quarter", "2026-Q1", "short", lambda p: seen.append(p) or "- do it [[chunk:c1]]")
    assert out["citations"] == ["c1"] and seen[0].index("[[chunk:c2]]") < seen[0].index("[[chunk:c1]]")
    for ids, code in (([], "REQUIRED"), (["c1", "zz"], "INVALID")):
        with pytest.raises(TidelogError, match=code):
            drafting.draft(c, ids, "action_plan_next_quarter", "2026-Q1", "short", lambda p: p)
    for text, code in (("- a", "REQUIRED"), ("- a [[chunk:c1]]\n- b", "REQUIRED"), ("- a [[chunk:zz]]", "INVALID")):
        with pytest.raises(TidelogError, match=code):
            drafting.check(text, ["c1"])


def test_loopback():
    assert drafting.loopback("http://127.0.0.1:11434") and drafting.loopback("http://127.0.0.1")
    for bad in ("http://localhost:1", "https://127.0.0.1", "http://127.0.0.1:0", "http://127.0.0.1:70000", "http://127.0.0.1:80/x", "http://u@127.0.0.1", "http://127.0.0.1:80?x"):
        assert not drafting.loopback(bad)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("2026-01-05T12:00:00Z ann: x\n2026-01-05T12:30:00Z ann: y\n")
    out = str(tmp_path / "out")
    q = timeline.sink(timeline.files(spark, str(tmp_path / "in")), lambda b, i: b.drop("warning").write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination(60)
    events = spark.read.parquet(out)
    assert events.count() == 2
    assert [r["n"] for r in timeline.windowed(events).collect()] == [2]


def test_snippets_of_all_documents(spark, tmp_path):
    """Every row and language, cut at whole characters of one to four bytes."""
    from tidelog import queries

    cut = lambda t: t if len(t.encode()) <= 280 else t.encode()[:280].decode("utf-8", "ignore") + "..."
    texts = [None, "", "  ", " kurz ", *[pad * "a" + c * 300 for c in ("a", "ü", "中", "😀") for pad in range(4)], "é" * 140, "é" * 140 + "x", " " + "ß" * 200 + " "]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in ("en", "de", "fr", "es", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["snippet"] or "", r["snippet"] is None) for r in queries.QUERIES["snippets"](spark, str(tmp_path)).collect())
    assert got == sorted((i, cut((t or "").strip(" ")), t is None) for i, t, _ in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_follow_their_definitions(spark):
    """Source and chunk ids against the JSON that they hash, written out."""
    s = ev.new_source(spark, "freeform_text", "paste", "notes", "2026-01-01T00:00:00Z", text="one\r\ntwo\r\n\r\nthree").first()
    assert s["source_id"] == sha('{"origin":{"kind":"paste","path":null},"type":"freeform_text"}') and s["text"] == "one\ntwo\n\nthree"
    c = ev.chunks(spark.createDataFrame([(s["source_id"], s["text"])], "source_id string, text string")).first()
    about = sha('{"incident_keys":null,"kind":"paragraph","time_range":null}')
    assert c["chunk_id"] == sha(f"v1|{s['source_id']}|0|{sha(s['text'])}|{about}")
    for bad in (("x", "paste", "l", None, "t"), ("freeform_text", "url", "l", None, "t"), ("freeform_text", "paste", " ", None, "t"), ("freeform_text", "file", "l", None, None), ("freeform_text", "paste", "l", None, " \n")):
        with pytest.raises(TidelogError, match="AI_EVIDENCE_SOURCE_INVALID"):
            ev.check_source(*bad)


@pytest.fixture
def export(spark):
    moments = ["2026-02-01T08:00:00Z", None, None, None, None, "2026-02-01T09:00:00Z"]
    row = lambda key, sev, pct: (key, sev, None, "VENDOR_A", None, pct, None, *moments, (60, None, None, None, 3600), 2)
    incidents = spark.createDataFrame([row("INC_002", None, None), row("INC_001", "SEV1", 40)], sanitizing.INCIDENTS)
    events = spark.createDataFrame([("INC_001", "slack", "2026-02-01T08:30:00Z", None, True), ("INC_001", "slack", None, "message", True)], sanitizing.EVENTS)
    warnings = spark.createDataFrame([("INC_001", "Z"), ("INC_001", "A"), ("INC_001", "Z")], sanitizing.WARNINGS)
    return incidents, events, warnings


def test_bundles(spark, export):
    got = ev.bundle_chunks("src", *export).orderBy("ordinal").collect()
    assert [r["meta"]["incident_keys"] for r in got] == [["INC_001"], ["INC_002"]] and got[1]["ordinal"] == 1
    assert got[0]["text"].split("\n") == [
        "Incident Key: INC_001", "Severity: SEV1", "Vendor: VENDOR_A", "Impact %: 40", "Timestamps (RFC3339, nullable):", "  start_ts: 2026-02-01T08:00:00Z", "  first_observed_ts: NULL", "  it_awareness_ts: NULL",
        "  ack_ts: NULL", "  mitigate_ts: NULL", "  resolve_ts: 2026-02-01T09:00:00Z", "Deterministic metrics (seconds, nullable):", "  mttd_seconds: 60", "  it_awareness_lag_seconds: NULL", "  mtta_seconds: NULL",
        "  time_to_mitigation_seconds: NULL", "  mttr_seconds: 3600", "Warning count: 2", "Warnings (codes):", "  - A", "  - Z", "Timeline events (sanitized):",
        "  - ts=NULL; source=slack; kind=message; text_redacted=true", "  - ts=2026-02-01T08:30:00Z; source=slack; kind=NULL; text_redacted=true",
    ]
    assert "Warnings" not in got[1]["text"] and "Severity" not in got[1]["text"]
    about = sha('{"incident_keys":["INC_001"],"kind":"sanitized_incident_bundle","time_range":{"end_ts":"2026-02-01T09:00:00Z","start_ts":"2026-02-01T08:00:00Z"}}')
    assert got[0]["chunk_id"] == sha(f"v1|src|0|{sha(got[0]['text'])}|{about}")


def test_rebuild(spark, export, tmp_path):
    (tmp_path / "r.md").write_text("alpha\n\nbeta")
    make = lambda *a, **k: ev.new_source(spark, *a, **k)
    registry = make("freeform_text", "paste", "p", "t", text="gamma").unionByName(make("incident_report_md", "file", "f", "t", path=str(tmp_path / "r.md"))).unionByName(make("sanitized_export", "directory", "d", "t", path="/x"))
    read = lambda path: export
    whole = ev.rebuild(spark, registry, None, read)
    assert sorted(r["text"].split("\n")[0] for r in whole.collect()) == ["Incident Key: INC_001", "Incident Key: INC_002", "alpha", "gamma"]
    paste = registry.filter("type = 'freeform_text'")
    changed = registry.filter("type <> 'freeform_text'").unionByName(paste.withColumn("text", F.lit("delta")))
    again = ev.rebuild(spark, changed, whole, read, only=paste.first()["source_id"])
    assert sorted(r["text"].split("\n")[0] for r in again.collect()) == ["Incident Key: INC_001", "Incident Key: INC_002", "alpha", "delta"]
    for only, code in ((None, "AI_EVIDENCE_EMPTY"), ("nope", "AI_EVIDENCE_SOURCE_INVALID")):
        with pytest.raises(TidelogError, match=code):
            ev.rebuild(spark, registry.limit(0), whole, read, only=only)


def vectors_of(texts):
    return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


def test_index_rules_and_retrieval(spark, tmp_path):
    c = ev.chunks(spark.createDataFrame([("s1", "aaaa"), ("s2", "bbbbbbbbbbbb"), ("s3", "a" * 400)], "source_id string, text string"))
    none = c.select("chunk_id", "text_sha256", F.array().cast("array<float>").alias("embedding")).limit(0)
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return vectors_of(texts)

    index, st = ev.refresh_index(c, none, ev.IndexStatus(), embed, "m1", "t1")
    assert (st.ready, st.model, st.dims, st.chunk_count, st.chunks_total, st.source_id) == (True, "m1", 3, 3, 3, None) and calls.value == 3
    _, st2 = ev.refresh_index(c, index, st, embed, "m1", "t2")
    assert calls.value == 3 and st2.updated_at == "t2"
    ev.refresh_index(c, index, st, embed, "m2", "t3")  # another model keeps no vector
    assert calls.value == 6
    one, scoped = ev.refresh_index(c, index, st, embed, "m1", "t4", source="s1")  # nor does another scope
    assert calls.value == 7 and (one.count(), scoped.chunks_total, scoped.source_id) == (1, 1, "s1")
    for table, code in ((c.limit(0), "AI_INDEX_NOT_READY"), (c, "AI_INDEX_BUILD_FAILED")):
        with pytest.raises(TidelogError, match=code):
            ev.refresh_index(table, none, ev.IndexStatus(), lambda xs: [[1.0] * len(x) for x in xs], "m", "t")
    files = Files(spark, str(tmp_path))
    assert ev.read_status(files) == ev.IndexStatus()
    ev.write_status(files, st)
    ev.write_status(files, st2)
    assert ev.read_status(files) == st2

    hits = ev.retrieve(c, index, st, vectors_of, " aaaaa ", 2).collect()
    assert [h["source_id"] for h in hits][0] in ("s1", "s3") and len(hits) == 2 and hits[0]["score"] >= hits[1]["score"]
    long = ev.retrieve(c, index, st, vectors_of, "a", 9, ["s3"]).first()
    assert long["snippet"] == "a" * 280 + "..." and long["locator"]["source_id"] == "s3"
    for question, status, embedder, code in (("  ", st, vectors_of, "AI_RETRIEVAL_FAILED"), ("q", ev.IndexStatus(), vectors_of, "AI_INDEX_NOT_READY"), ("q", st, lambda x: [[1.0]], "AI_RETRIEVAL_FAILED"), ("q", st, lambda x: [[0.0] * 3], "AI_RETRIEVAL_FAILED")):
        with pytest.raises(TidelogError, match=code):
            ev.retrieve(c, index, status, embedder, question, 3)
    cites = ev.locator(c)
    ev.check_citations(cites, c)
    moved = cites.withColumn("locator", F.col("locator").withField("ordinal", F.col("locator.ordinal") + 1))
    for wrong, code in ((cites.limit(0), "AI_CITATION_REQUIRED"), (moved, "AI_CITATION_INVALID"), (cites.withColumn("chunk_id", F.lit("x")), "AI_EVIDENCE_NOT_FOUND")):
        with pytest.raises(TidelogError, match=code):
            ev.check_citations(wrong, c)
    rows, env = ev.chunk_page(c, 2, 2)
    assert rows.count() == 1 and env == {"total": 3, "limit": 2, "offset": 2, "has_next": False, "has_prev": True}
    with pytest.raises(TidelogError, match="INVALID_PAGINATION"):
        ev.chunk_page(c, 101)


def test_drafts(spark):
    none = spark.createDataFrame([], DRAFT)
    blank = dict.fromkeys(DRAFT.fieldNames())
    draft = lambda **k: blank | {"quarter_label": "2026-Q1", "section_type": "exec_summary", "draft_text": 'a "b" ü', "citation_chunk_ids": ["c1", "c2"], "model_name": "m", "model_params_hash": "p", "prompt_template_version": "v", "created_at": "2026-01-01T00:00:00Z"} | k
    table = dr.create(spark.createDataFrame([draft(), draft(created_at="2026-01-02T00:00:00Z")], DRAFT), none)
    first, second = table.orderBy("id").collect()
    assert first["artifact_hash"] == sha('{"quarter_label":"2026-Q1","section_type":"exec_summary","draft_text":"a \\"b\\" ü","citation_chunk_ids":["c1","c2"],"model_name":"m","model_params_hash":"p","prompt_template_version":"v","created_at":"2026-01-01T00:00:00Z"}')
    assert (first["id"], second["id"], first["revision_number"]) == (1, 2, 1) and first["artifact_hash"] != second["artifact_hash"]
    # the parent isn't part of a draft's identity, the time is
    with pytest.raises(TidelogError, match="DB_AI_DRAFT_CREATE_FAILED"):
        dr.create(spark.createDataFrame([draft(parent_draft_id=2)], DRAFT), table)
    more = dr.create(spark.createDataFrame([draft(parent_draft_id=2, created_at="2026-01-03T00:00:00Z")], DRAFT), table)
    assert dr.get(more, 3).first()["revision_number"] == 2
    with pytest.raises(TidelogError, match="DB_NOT_FOUND"):
        dr.get(more, 9)
    for bad, code in (({"citation_chunk_ids": []}, "AI_CITATION_REQUIRED"), ({"draft_text": " "}, "DB_AI_DRAFT_INVALID"), ({"model_params_hash": ""}, "DB_AI_DRAFT_INVALID"), ({"parent_draft_id": 77}, "DB_NOT_FOUND")):
        with pytest.raises(TidelogError, match=code):
            dr.create(spark.createDataFrame([draft(**bad)], DRAFT), table)


def test_long_lineage(spark):
    """A chain of 10,000, a second root, a ring and an orphan."""
    rows = [(i, i - 1 if i else None) for i in range(10_000)] + [(20_000, None), (20_001, 20_000), (30_000, 30_001), (30_001, 30_000), (40_000, 99_999)]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in dr.lineage(spark.createDataFrame(rows, "id long, parent_draft_id long")).collect()}
    assert got == {**{i: (0, i) for i in range(10_000)}, 20_000: (20_000, 0), 20_001: (20_000, 1)}


def test_ranks(spark):
    """Ranks over many ranges are those of one sort, and no exchange brings all rows together."""
    f = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(900))).repartition(7)
    order = [F.col("v").desc(), F.col("id")]
    got = {r["id"]: r["rn"] for r in tables.ranked(f, order).collect()}
    assert got == {r["id"]: n + 1 for n, r in enumerate(f.orderBy(*order).collect())}
    assert tables.ranked(f.limit(0), order).count() == 0


def test_transcript_targets(spark):
    incidents, events = spark.createDataFrame([], INCIDENT), spark.createDataFrame([], TIMELINE)
    text = "2026-01-05T12:00:00Z ann: hello\nno time\n"
    table, line, warnings = tr.ingest(text, incidents, events, "2026-01-06T00:00:00Z", title=" Outage ")
    row = table.first()
    assert (row["id"], row["title"], row["fingerprint"]) == (1, "Outage", sha(f"slack_shell|title=outage|sha={sha(text)}"))
    assert [(r["id"], r["incident_id"], r["author"], r["text"]) for r in line.orderBy("id").collect()] == [(1, 1, "ann", "hello"), (2, 1, None, "no time")] and warnings.count() == 1
    _, more, _ = tr.ingest("ann: x", table, line, "t", incident_id=1)
    assert more.count() == 3 and more.agg(F.max("id")).first()[0] == 3
    for kw, code in (({"incident_id": 1, "title": "x"}, "AMBIGUOUS"), ({}, "TARGET_REQUIRED"), ({"title": " "}, "TITLE_REQUIRED"), ({"incident_id": 5}, "NOT_FOUND"), ({"title": "Outage"}, "CREATE_FAILED")):
        with pytest.raises(TidelogError, match=code):
            tr.target(table, text, **kw)


def test_many_queries_at_once(spark, monkeypatch):
    import math
    import random

    r = random.Random(6)
    vec = lambda n: [r.gauss(0, 1) for _ in range(n)]
    rows = [(f"c{i:03d}", vec(8) if i % 9 else [0.0] * 8) for i in range(120)] + [(f"d{i}", [1.0] * 8) for i in range(40)] + [("n", None), ("short", [1.0]), ("bad", [float("nan")] * 8)]
    asked = [(f"q{i}", vec(8)) for i in range(7)] + [("ones", [2.0] * 8), ("zero", [0.0] * 8), ("one", [3.0]), ("none", None)]
    monkeypatch.setattr(ev, "QUERY_BLOCK", 4)
    frame = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    got = ev.search_many(frame, spark.createDataFrame(asked, "query_id string, embedding array<float>"), 12).collect()
    want = {}
    for q, a in asked:
        if a and any(a):
            size = lambda x: math.sqrt(sum(c * c for c in x))
            scored = [(-round(sum(x * y for x, y in zip(a, v, strict=True)) / size(a) / size(v), 5), c) for c, v in rows if v and len(v) == len(a) and any(v) and v[0] == v[0]]
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(sorted(scored)[:12])}
    assert {(x.query_id, x["rank"]): (x.chunk_id, round(x.score, 5)) for x in got} == want
    assert ev.search_many(frame, spark.createDataFrame([], "query_id string, embedding array<float>"), 3).collect() == []
