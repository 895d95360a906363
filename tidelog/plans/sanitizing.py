"""Export without free text, and its checked import."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import TidelogError
from tidelog.functions import incident as inc
from tidelog.operators import tables
from tidelog.schema import INCIDENT, METRICS, MOMENTS, RAW, TIMELINE
from tidelog.sources.workspace import Files, file_hashes, text_hash, tree_hashes

REDACTED = "[REDACTED]"
REDACTION_MARK = '{"text_redacted":true}'
FILES = ("incidents.json", "timeline_events.json", "warnings.json")
MANIFEST_VERSION = 1

INCIDENTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("incident_key", "severity", "detection_source", "vendor", "service")]
    + [T.StructField(c, T.LongType()) for c in ("impact_pct", "service_health_pct")]
    + [T.StructField(c, T.StringType()) for c in MOMENTS]
    + [T.StructField("metrics", T.StructType([T.StructField(c, T.LongType()) for c in METRICS])), T.StructField("warning_count", T.LongType())]
)
EVENTS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("incident_key", "source", "ts", "kind")], T.StructField("text_redacted", T.BooleanType())])
WARNINGS = T.StructType([T.StructField("incident_key", T.StringType()), T.StructField("code", T.StringType())])


# keys: those of tables.incident_keys, for callers that need them more than once


def incident_rows(incidents: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Incidents with keys for ids, pseudonyms for categories, metrics and a warning count; no title, no description."""
    out = incidents.join(tables.incident_keys(incidents) if keys is None else keys, "id")
    for column, make, prefix in (("vendor", tables.lettered, "VENDOR"), ("service", tables.numbered, "SERVICE"), ("detection_source", tables.numbered, "DETECT")):
        names = make(incidents, column, prefix)
        out = out.join(names, F.col(column) == F.col("value"), "left").withColumn(column, F.col("pseudonym")).drop("value", "pseudonym")
    out = inc.with_metrics(out).withColumn("warning_count", F.size(inc.validation_warnings()).cast("long"))
    return out.select("incident_key", "severity", "detection_source", "vendor", "service", "impact_pct", "service_health_pct", *MOMENTS, F.struct(*METRICS).alias("metrics"), "warning_count")


def event_rows(events: DataFrame, incidents: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    keys = (tables.incident_keys(incidents) if keys is None else keys).withColumnRenamed("id", "incident_id")
    # events without an incident need no partner, and may be many
    known = events.filter("incident_id is not null").join(keys, "incident_id", "left")
    return known.unionByName(events.filter("incident_id is null").withColumn("incident_key", F.lit(None).cast("string"))).select(F.coalesce("incident_key", F.lit("INC_UNKNOWN")).alias("incident_key"), "source", "ts", "kind", F.lit(True).alias("text_redacted"))


def warning_rows(incidents: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    keyed = incidents.join(tables.incident_keys(incidents) if keys is None else keys, "id")
    return keyed.select("incident_key", F.explode(F.transform(inc.validation_warnings(), lambda w: w["code"])).alias("code"))


def _ordered_events(events: DataFrame) -> DataFrame:
    return events.orderBy("incident_key", F.col("ts").asc_nulls_first(), "source")


def export(spark: SparkSession, incidents: DataFrame, events: DataFrame, folder: str, export_time: str, app_version: str) -> dict:
    """Three pretty JSON files and a manifest in a new folder.  For review-sized sets; ``export_large`` is for any."""
    files = Files(spark, folder)
    if files.exists():
        raise TidelogError("EXPORT_SANITIZED_EXISTS", "The export folder exists already", folder)
    keys = tables.incident_keys(incidents)
    frames = (incident_rows(incidents, keys).orderBy("incident_key"), _ordered_events(event_rows(events, incidents, keys)), warning_rows(incidents, keys).orderBy("incident_key", "code"))
    listed = []
    for name, frame in zip(FILES, frames, strict=True):
        whole = frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
        text = json.dumps([json.loads(r["j"]) for r in whole.toLocalIterator()], indent=2, ensure_ascii=False)
        files.write(text, name)
        listed.append({"filename": name, "bytes": len(text.encode()), "sha256": text_hash(text)})
    manifest = {"manifest_version": MANIFEST_VERSION, "app_version": app_version, "export_time": export_time, "incident_count": incidents.count(), "files": sorted(listed, key=lambda x: x["filename"])}
    files.write(json.dumps(manifest, indent=2), "manifest.json")
    return manifest


#: The folders of a large export, whose files are JSON lines.
FOLDERS = ("incidents", "timeline_events", "warnings")


def export_large(spark: SparkSession, incidents: DataFrame, events: DataFrame, folder: str, export_time: str, app_version: str) -> dict:
    """As ``export`` for sets of any size: three folders of JSON lines, written and hashed on the workers, and a manifest of their files."""
    files = Files(spark, folder)
    if files.exists():
        raise TidelogError("EXPORT_SANITIZED_EXISTS", "The export folder exists already", folder)
    keys = tables.incident_keys(incidents)
    for name, frame in zip(FOLDERS, (incident_rows(incidents, keys), event_rows(events, incidents, keys), warning_rows(incidents, keys)), strict=True):
        frame.write.option("ignoreNullFields", False).json(f"{folder}/{name}")
    listed = [f | {"filename": f"{name}/{f['filename']}"} for name in FOLDERS for f in tree_hashes(spark, f"{folder}/{name}")]
    manifest = {"manifest_version": MANIFEST_VERSION, "app_version": app_version, "export_time": export_time, "incident_count": incidents.count(), "files": listed}
    files.write(json.dumps(manifest, indent=2), "manifest.json")
    return manifest


def _is_large(spark: SparkSession, folder: str) -> bool:
    return Files(spark, folder).exists(FOLDERS[0])


def verify(spark: SparkSession, folder: str) -> dict:
    """The manifest, after checks in order: version, required files, hashes, sizes."""
    files = Files(spark, folder)
    manifest = json.loads(files.read("manifest.json"))
    if manifest.get("manifest_version") != MANIFEST_VERSION:
        raise TidelogError("INGEST_SANITIZED_MANIFEST_VERSION", "Unknown manifest version", str(manifest.get("manifest_version")))
    listed = {f["filename"]: f for f in manifest["files"]}
    if _is_large(spark, folder):
        found = {f"{name}/{f['filename']}": f for name in FOLDERS for f in tree_hashes(spark, f"{folder}/{name}")}
        wanted = sorted(listed.keys() | found.keys())
    else:
        wanted = list(FILES)
        for name in wanted:
            if name not in listed or not files.exists(name):
                raise TidelogError("INGEST_SANITIZED_FILE_MISSING", "A required file is missing", name)
        found = {r["filename"]: r.asDict() for r in file_hashes(spark, f"{folder}/*.json").collect()}
    for name in wanted:
        if name not in listed or name not in found:
            raise TidelogError("INGEST_SANITIZED_FILE_MISSING", "A file is missing, or not listed", name)
        if found[name]["sha256"] != listed[name]["sha256"]:
            raise TidelogError("INGEST_SANITIZED_HASH_MISMATCH", "A file is not as listed", name)
        if found[name]["bytes"] != listed[name]["bytes"]:
            raise TidelogError("INGEST_SANITIZED_SIZE_MISMATCH", "A file is not as listed", name)
    return manifest


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    large = _is_large(spark, folder)
    get = lambda name, schema: spark.read.schema(schema).option("multiLine", not large).option("mode", "FAILFAST").json(f"{folder}/{name}")
    return tuple(get(n, t) for n, t in zip(FOLDERS if large else FILES, (INCIDENTS, EVENTS, WARNINGS), strict=True))


def restored(rows: DataFrame) -> DataFrame:
    """Incident rows of an export as incidents: synthetic titles, fingerprints of the key, ids in order of the key."""
    out = rows.withColumns({
        "external_id": F.col("incident_key"), "title": F.concat(F.lit("Incident "), "incident_key"), "description": F.lit(None).cast("string"),
        "fingerprint": F.sha2(F.concat(F.lit("sanitized|incident_key="), "incident_key"), 256), **{r: F.lit(None).cast("string") for r in RAW},
    })
    none = out.select(F.lit(0).cast("long").alias("id")).limit(0)
    return tables.next_ids(out, none, [F.col("incident_key")])


def mismatched_metrics(restored_rows: DataFrame) -> DataFrame:
    """Rows whose listed metrics are not those of their timestamps; empty for a sound export."""
    again = F.struct(*[c.alias(k) for k, c in inc.metrics().items()])
    return restored_rows.filter(~F.col("metrics").eqNullSafe(again))


def reconciliation(expected: DataFrame, incidents: DataFrame) -> DataFrame:
    """``code, missing, extra`` between listed warning codes and those of the restored incidents."""
    actual = incidents.select(F.col("external_id").alias("incident_key"), F.explode(F.transform(inc.validation_warnings(), lambda w: w["code"])).alias("code"))
    return tables.multiset_difference(expected, actual)


def restore(spark: SparkSession, folder: str, target_empty: bool = True) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Incidents, events and import warnings of a verified export, for an empty target."""
    if not target_empty:
        raise TidelogError("INGEST_SANITIZED_DB_NOT_EMPTY", "The target has data already")
    manifest = verify(spark, folder)
    rows, events, listed = read(spark, folder)
    n = rows.count()
    if n != manifest["incident_count"]:
        raise TidelogError("INGEST_SANITIZED_INCIDENT_COUNT_MISMATCH", "The manifest counts other incidents than the file has", f"manifest_incident_count={manifest['incident_count']}; incidents_len={n}")
    table = restored(rows)
    wrong = mismatched_metrics(table).select("incident_key").limit(1).collect()
    if wrong:
        raise TidelogError("INGEST_SANITIZED_METRICS_MISMATCH", "Metrics do not match their timestamps", f"incident_key={wrong[0][0]}")
    if not events.filter("not text_redacted or text_redacted is null").isEmpty():
        raise TidelogError("INGEST_SANITIZED_EVENT_NOT_REDACTED", "An event has text that is not redacted")
    joined = events.join(table.select("incident_key", F.col("id").alias("incident_id")), "incident_key", "left")
    lost = joined.filter("incident_id is null").select("incident_key").limit(1).collect()
    if lost:
        raise TidelogError("INGEST_SANITIZED_EVENT_INCIDENT_UNKNOWN", "An event has an unknown incident", f"incident_key={lost[0][0]}")
    made = joined.withColumns({"author": F.lit(None).cast("string"), "text": F.lit(REDACTED), "raw_json": F.lit(REDACTION_MARK), "created_at": F.lit(manifest["export_time"])})
    made = tables.next_ids(made, made.select(F.lit(0).cast("long").alias("id")).limit(0), [F.col("incident_key"), F.col("ts").asc_nulls_first(), F.col("source")])
    notes = [
        {"code": "INGEST_SANITIZED_TITLE_REDACTED", "details": f"incidents={n}"},
        {"code": "INGEST_SANITIZED_TIMELINE_TEXT_REDACTED", "details": f"timeline_events={events.count()}"},
    ]
    diff = reconciliation(listed, table)
    if not diff.isEmpty():
        top = lambda c: tables.top_codes(diff.filter(F.col(c) > 0).select("code", F.col(c).alias("n"))).first()[0]
        notes.append({"code": "INGEST_SANITIZED_WARNINGS_MISMATCH", "details": f"missing_top=[{top('missing')}]; extra_top=[{top('extra')}]"})
    return table.select(*INCIDENT.fieldNames()), made.select(*TIMELINE.fieldNames()), notes
