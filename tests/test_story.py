"""The story fixture: import, metrics, distributions, report, export and restore, against values worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.errors import TidelogError
from tidelog.functions import incident as inc
from tidelog.operators import analytics as an
from tidelog.operators import tables as tb
from tidelog.plans import backup, dashboard, importing, report, sanitizing
from tidelog.schema import INCIDENT, METRICS, TIMELINE
from tidelog.sources import demo, issues_csv
from tidelog.sources.workspace import Workspace

HEADER = "Ticket,Headline,Notes,Level,FoundBy,Supplier,System,ImpactPct,HealthPct,Began,Seen,Aware,Acked,Eased,Fixed"
STORY = HEADER + """
OPS-11,"Checkout queue stalls",,SEV1,alert,Northwind,checkout,40,70,2026-02-03T06:00:00Z,2026-02-03T06:02:00Z,2026-02-03T06:12:00Z,2026-02-03T06:15:00Z,2026-02-03T06:45:00Z,2026-02-03T08:00:00Z
OPS-12,"Login page slow",,SEV2,user,Northwind,login,10,95,2026-02-04T10:00:00Z,2026-02-04T10:00:30Z,2026-02-04T10:01:00Z,2026-02-04T10:01:20Z,2026-02-04T10:06:20Z,2026-02-04T10:20:00Z
OPS-13,"Disk almost full",,SEV3,,Harbor,storage,,80,2026-02-05T01:00:00Z,,,2026-02-05T01:30:00Z,,2026-02-05T03:00:00Z
OPS-14,"Import with odd times",,SEV2,user,Harbor,imports,25,60,03/02/2026 9:00,,,,,03/02/2026 11:00
OPS-15,"Cache flush storm",,SEV4,alert,Quay,cache,5,50,2026-02-07T00:00:00Z,2026-02-07T00:01:00Z,2026-02-07T00:08:00Z,2026-02-07T00:09:00Z,2026-02-07T00:30:00Z,2026-02-07T00:50:00Z
"""
MAPPING = dict(zip(("external_id", "title", "description", "severity", "detection_source", "vendor", "service", "impact_pct", "service_health_pct", "start_ts", "first_observed_ts", "it_awareness_ts", "ack_ts", "mitigate_ts", "resolve_ts"), HEADER.split(","), strict=True))


def load(spark, tmp_path, text, existing=None, name="a.csv"):
    path = tmp_path / name
    path.write_text(text)
    cells = issues_csv.mapped(issues_csv.read(spark, str(path)), issues_csv.header(spark, str(path)), MAPPING)
    return importing.upsert(issues_csv.staged(cells), existing if existing is not None else spark.createDataFrame([], INCIDENT))


@pytest.fixture(scope="module")
def story(spark, tmp_path_factory):
    r = load(spark, tmp_path_factory.mktemp("story"), STORY)
    return spark.createDataFrame(r.incidents.collect(), INCIDENT), r


def test_import(story):
    table, result = story
    assert result.summary() == {"inserted": 5, "updated": 0, "skipped": 0, "conflicts": 0, "warnings": 4}
    assert [r["code"] for r in result.warnings.collect()] == ["INGEST_TS_UNPARSEABLE", "INGEST_TS_RAW_STORED"] * 2
    prints = {r["external_id"]: r["fingerprint"] for r in table.collect()}
    assert prints["OPS-13"] == hashlib.sha256(b"title=disk almost full|start=2026-02-05T01:00:00Z|first_observed=|ack=2026-02-05T01:30:00Z|mitigate=|resolve=2026-02-05T03:00:00Z").hexdigest()
    assert len(set(prints.values())) == 5


def test_metrics(story):
    rows = {r["external_id"]: tuple(r[m] for m in METRICS) for r in inc.with_metrics(story[0]).collect()}
    assert rows == {"OPS-11": (120, 600, 180, 1800, 7200), "OPS-12": (30, 30, 20, 300, 1200), "OPS-13": (None, None, None, None, 7200), "OPS-14": (None,) * 5, "OPS-15": (60, 420, 60, 1260, 3000)}


def test_distributions(story):
    f = {k: [(r["label"] if "label" in r else r["severity"], r["count"]) for r in (x.asDict() for x in v.collect())] for k, v in dashboard.frames(story[0]).items()}
    assert f["severity_counts"] == [("SEV1", 1), ("SEV2", 2), ("SEV3", 1), ("SEV4", 1)]
    assert f["detection_source_mix"] == [("alert", 2), ("user", 2), ("UNKNOWN", 1)]
    assert f["it_awareness_lag_buckets"] == [("0-5m", 1), ("5-15m", 2), ("UNKNOWN (unparseable/missing)", 2)]
    pain = [(r["label"], r["pain_sum"], r["count"], r["pain_known_count"]) for r in dashboard.frames(story[0])["top_vendors_by_pain"].collect()]
    assert pain == [("Northwind", 8700000, 2, 2), ("Quay", 750000, 1, 1), ("Harbor", 0, 2, 0)]
    for frame in dashboard.frames(story[0]).values():
        assert an.reconciles(frame, story[0]).first()["ok"]


def test_percentiles(story):
    m = inc.with_metrics(story[0])
    got = {r["metric"]: tuple(r)[1:] for r in an.rank_percentiles(m, list(METRICS)).collect()}
    assert got["mttd_seconds"] == (3, 5, 60, 60) and got["mttr_seconds"] == (4, 5, 3000, 7200)
    assert m.agg(an.percentile(F.col("mtta_seconds"), 90)).first()[0] == 60


def test_import_again_changes_nothing_and_keeps_values(spark, tmp_path, story):
    assert load(spark, tmp_path, STORY, story[0]).summary()["skipped"] == 5
    text = HEADER + "\nOPS-11,Checkout queue stalls,,,,,,,,,,,,,\n"
    r = load(spark, tmp_path, text, story[0], "b.csv")
    assert r.summary()["skipped"] == 1
    text = HEADER + "\nOPS-11,New title,,,,,,,,,,,,,2026-02-03T08:40:00Z\n"
    r = load(spark, tmp_path, text, story[0], "c.csv")
    row = r.incidents.filter("external_id = 'OPS-11'").first()
    assert r.summary()["updated"] == 1 and row["severity"] == "SEV1" and row["title"] == "New title" and row["resolve_ts"] == "2026-02-03T08:40:00Z"


def test_bad_rows_and_repeats(spark, tmp_path):
    text = HEADER + "\nA,One,,,,,,5,,,,,,,\nA,Two,,,,,,,,,,,,,\nshort,row\nB,,,,,,,,,,,,,,\nC,Three,,,,,,x,200,,,,,,\n"
    r = load(spark, tmp_path, text)
    s = r.summary()
    assert (s["inserted"], s["skipped"], s["conflicts"]) == (2, 3, 1)
    assert {(x["row"], x["code"]) for x in r.warnings.collect()} == {(2, "INGEST_CSV_PARSE_FAILED"), (3, "INGEST_MISSING_TITLE"), (4, "VALIDATION_PCT_PARSE_FAILED"), (4, "VALIDATION_PCT_OUT_OF_RANGE")}


def test_allowed_timestamps(spark, tmp_path):
    text = HEADER + "\nI,T,,,,,,,,2026-02-01 00:00:00,,,2026-02-01 00:05,,2026-02-01T00:10:00+00:00\n"
    row = load(spark, tmp_path, text).incidents.first()
    assert (row["start_ts"], row["start_ts_raw"]) == ("2026-02-01T00:00:00Z", "2026-02-01 00:00:00")
    assert (row["ack_ts"], row["resolve_ts"], row["resolve_ts_raw"]) == ("2026-02-01T00:05:00Z", "2026-02-01T00:10:00Z", None)


def test_report(story):
    text = report.markdown(story[0])
    assert text.startswith("# Quarterly Incident Review\n\nIncident count: **5**\n")
    assert "| MTTR (start/observed → resolve) | 4/5 | 50m 0s | 2h 0m |" in text
    assert "- Northwind: pain_sum=8700000, incidents=2, pain_known=2" in text
    rows = [x for x in text.split("\n") if x.startswith("| OPS-")]
    assert [x[2:8] for x in rows] == ["OPS-11", "OPS-12", "OPS-13", "OPS-14", "OPS-15"] and rows[2] == "| OPS-13 | Disk almost full | SEV3 | UNKNOWN | Harbor | storage | 2h 0m | 0 |"
    assert text.endswith("### OPS-14: Import with odd times\n\n- Warning codes: VALIDATION_TS_RAW_PRESENT, VALIDATION_TS_RAW_PRESENT\n\n")
    assert report.markdown(story[0].filter("id = 1")).endswith("\n- None.\n")


def test_sanitized_round_trip(spark, tmp_path, story):
    events = spark.createDataFrame([(1, 1, "chat", "2026-02-03T06:10:00Z", "ann", "message", "secret words", None, "x"), (2, 2, "chat", None, None, None, "more", None, "x")], TIMELINE)
    folder = str(tmp_path / "export")
    sanitizing.export(spark, story[0], events, folder, "2026-03-01T00:00:00Z", "1.0")
    for name in sanitizing.FILES:
        body = (tmp_path / "export" / name).read_text()
        assert "queue" not in body and "secret" not in body and "Northwind" not in body
    table, made, notes = sanitizing.restore(spark, folder)
    assert table.count() == 5 and {r["text"] for r in made.collect()} == {sanitizing.REDACTED}
    # raw timestamps are not exported, so their warnings are missing after the restore
    assert [n["code"] for n in notes][-1] == "INGEST_SANITIZED_WARNINGS_MISMATCH"
    with pytest.raises(TidelogError, match="EXPORT_SANITIZED_EXISTS"):
        sanitizing.export(spark, story[0], events, folder, "t", "1.0")
    (tmp_path / "export" / ".warnings.json.crc").unlink()
    (tmp_path / "export" / "warnings.json").write_text("[]")
    with pytest.raises(TidelogError, match="HASH_MISMATCH"):
        sanitizing.restore(spark, folder)


def test_large_export_round_trip(spark, tmp_path, story):
    events = spark.createDataFrame([(1, 1, "chat", "2026-02-03T06:10:00Z", "ann", "message", "secret words", None, "x")], TIMELINE)
    folder = str(tmp_path / "export")
    manifest = sanitizing.export_large(spark, story[0].repartition(2), events, folder, "2026-03-01T00:00:00Z", "1.0")
    assert manifest["incident_count"] == 5 and len(manifest["files"]) >= 3
    table, made, _ = sanitizing.restore(spark, folder)
    assert table.count() == 5 and [r["text"] for r in made.collect()] == [sanitizing.REDACTED]
    with pytest.raises(TidelogError, match="EXPORT_SANITIZED_EXISTS"):
        sanitizing.export_large(spark, story[0], events, folder, "t", "1.0")
    part = tmp_path / "export" / manifest["files"][0]["filename"]
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text(part.read_text().replace("SEV", "SAV"))
    with pytest.raises(TidelogError, match="HASH_MISMATCH"):
        sanitizing.restore(spark, folder)
    part.unlink()
    with pytest.raises(TidelogError, match="FILE_MISSING"):
        sanitizing.restore(spark, folder)


def test_workspace_backup_restore(spark, tmp_path, story):
    w = Workspace.create(spark, str(tmp_path / "w"))
    assert w.is_empty() and w.pending() == []
    w.replace("incidents", story[0])
    backup.create(w, str(tmp_path / "b"), "t", "1.0")
    w.replace("incidents", w.table("incidents").limit(1))
    with pytest.raises(TidelogError, match="RESTORE_TARGET_EXISTS"):
        backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "w"))
    back = backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "w"), allow_overwrite=True)
    assert back.counts() == {"incidents": 5, "timeline_events": 0, "artifacts": 0}
    p = back.put_profile("mine", MAPPING)
    assert back.profiles().first()["mapping"]["title"] == "Headline"
    back.drop_profile(p)
    with pytest.raises(TidelogError):
        back.drop_profile(p)


def test_demo(spark):
    d = demo.incidents(spark)
    pain = {r["label"]: r["pain_sum"] for r in dashboard.frames(d)["top_vendors_by_pain"].collect()}
    assert pain == {"AcmeCloud": 105600000, "ContosoNet": 41250000, "ExampleVendor": 9900000, "WidgetCo": 1650000}
    with pytest.raises(TidelogError, match="INVALID_PAGINATION"):
        tb.page(d, 0)
    rows, env = tb.page(d, 30, 30, "title", True)
    assert rows.count() == 10 and env["has_prev"] and not env["has_next"]


def test_cache(spark):
    d = demo.incidents(spark)
    c = dashboard.Cache(300)
    a = c.get(d, 2, now=0)
    assert c.get(d, 2, now=299) is a and c.get(d, 2, now=300) is not a
    assert c.stats() == {"entries": 1, "hits": 1, "misses": 2}
