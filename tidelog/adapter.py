"""The driver's tables seen as incident tables, so every operator can run on them at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import incident as inc
from tidelog.functions import times
from tidelog.schema import ARTIFACT, DRAFT, INCIDENT, RAW, TIMELINE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w) - 1)
    return e.withColumns({"grp": F.floor(F.col("rn") / 6), "pos": F.col("rn") % 6})


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six events of a user, in order, are the six moments of an incident."""
    e = _numbered(spark, sf_dir)
    at = [F.max(F.when(F.col("pos") == i, F.col("ts"))).alias(f"t{i}") for i in range(6)]
    g = e.groupBy("user_id", "grp").agg(F.min("event_id").alias("id"), *at, F.min("event_type").alias("et"), F.max("value").alias("mv"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    i, u = F.col("id"), F.col("user_id")
    unless = lambda n, v, c=i: F.when(c % n != 0, v)
    text = lambda c: times.render(c)
    swap = i % 17 == 0
    out = g.select(
        "id", unless(13, F.concat(F.lit("INC-"), i.cast("string"))).alias("external_id"), F.concat(F.lit("Incident "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("description"),
        unless(7, F.concat(F.lit("SEV"), (i % 4).cast("string"))).alias("severity"), unless(11, F.col("et")).alias("detection_source"),
        unless(19, F.concat(F.lit("vendor_"), (u % 12).cast("string")), u).alias("vendor"), F.concat(F.lit("svc_"), (u % 10).cast("string")).alias("service"),
        unless(5, F.floor("mv") % 125).cast("long").alias("impact_pct"), unless(9, F.col("k")).alias("service_health_pct"),
        unless(23, text(F.col("t0"))).alias("start_ts"), text(F.col("t1")).alias("first_observed_ts"), text(F.when(swap, F.col("t3")).otherwise(F.col("t2"))).alias("it_awareness_ts"),
        text(F.when(swap, F.col("t2")).otherwise(F.col("t3"))).alias("ack_ts"), text(F.col("t4")).alias("mitigate_ts"), text(F.col("t5")).alias("resolve_ts"), *[F.lit(None).cast("string").alias(r) for r in RAW],
    )
    return out.withColumn("fingerprint", inc.fingerprint()).select(*INCIDENT.fieldNames())


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a timeline event of its incident; some lack an incident or a time, some are redacted."""
    e = _numbered(spark, sf_dir)
    first = F.min("event_id").over(Window.partitionBy("user_id", "grp"))
    i = F.col("event_id")
    out = e.withColumn("incident", first).select(
        i.alias("id"), F.when(i % 29 != 0, F.col("incident")).alias("incident_id"), F.lit("stream").alias("source"), F.when(i % 31 != 0, times.render(F.col("ts"))).alias("ts"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"), F.col("event_type").alias("kind"),
        F.when(i % 3 == 0, "[REDACTED]").otherwise(F.concat("event_type", F.lit(" "), i.cast("string"))).alias("text"), F.col("props").alias("raw_json"), times.render(F.col("ts")).alias("created_at"),
    )
    return out.select(*TIMELINE.fieldNames())


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.when(i % 5 != 0, i).alias("incident_id"), F.col("lang").alias("kind"), F.sha2("text", 256).alias("sha256"), F.concat("source", F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("text"), F.format_string("2026-01-%02dT00:00:00Z", i % 28 + 1).alias("created_at"),
    ).select(*ARTIFACT.fieldNames())


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence sources; two blank-line paragraphs per line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.format_string("c%08d", "vec_id").alias("chunk_id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("text_sha256"), "embedding")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as drafts; each turn revises the one before it, every fifth starts anew."""
    c = table(spark, sf_dir, "conversations")
    i = F.col("conv_id") * 1000 + F.col("turn")
    parent = F.when(F.col("turn") % 5 != 0, i - 1)
    ids = F.array(F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")), F.concat(F.lit("c"), F.col("turn").cast("string")))
    cites = F.concat(F.lit("- "), F.coalesce("text", F.lit("")), F.lit(" [[chunk: c"), (F.col("conv_id") % 7).cast("string"), F.lit("]]\n- plain\n* [[chunk:c"), F.col("turn").cast("string"), F.lit("]] [[chunk:]]"))
    out = c.select(
        i.alias("id"), F.concat(F.lit("2026-Q"), (F.col("conv_id") % 4 + 1).cast("string")).alias("quarter_label"), F.when(F.col("role") == "user", "action_plan_next_quarter").otherwise("exec_summary").alias("section_type"),
        cites.alias("draft_text"), F.when(F.col("conv_id") % 11 != 0, ids).otherwise(F.array().cast("array<string>")).alias("citation_chunk_ids"), F.lit("model").alias("model_name"), F.lit("p").alias("model_params_hash"), F.lit("v1").alias("prompt_template_version"),
        F.format_string("2026-02-%02dT00:00:00Z", F.col("turn") % 28 + 1).alias("created_at"), F.sha2(i.cast("string"), 256).alias("artifact_hash"), parent.alias("parent_draft_id"), F.lit(1).alias("revision_number"),
        F.lit(None).cast("string").alias("revision_notes"), F.lit(None).cast("string").alias("branch_label"),
    )
    return out.select(*DRAFT.fieldNames())
