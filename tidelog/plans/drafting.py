"""Drafting a section from chosen evidence: prompt, model call, citation checks.  The model is an injected callable."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import TidelogError
from tidelog.operators import evidence
from tidelog.operators.drafts import SECTIONS
from tidelog.plans.dashboard import gate

#: What each section asks for, what must carry a citation, and what to do without evidence.
TASKS = {
    "exec_summary": ("Summarize the quarter for leadership in at most six bullets.", "every claim", "write UNKNOWN in its place"),
    "incident_highlights_top_n": ("List the incidents that mattered most, a bullet each.", "every bullet, on its own line", "leave the incident out"),
    "theme_analysis": ("Group what recurs into themes, a bullet each.", "every bullet, on its own line", "leave the theme out"),
    "action_plan_next_quarter": ("Propose actions for the next quarter, a bullet each.", "every bullet, on its own line", "leave the action out"),
    "quarter_narrative_recap": ("Tell the course of the quarter in two to six short paragraphs with blank lines between.", "every paragraph", "leave the paragraph out"),
}
MARK = "[[chunk:"


def prompt(section: str, quarter: str, wish: str, blocks: str) -> str:
    if section not in SECTIONS:
        raise TidelogError("AI_SECTION_INVALID", "Unknown section", section)
    task, cite, without = TASKS[section]
    rules = ["Take facts from the evidence below and from nowhere else.", f"Put a citation, written {MARK}<id>]], on {cite}.", f"Where the evidence does not say, {without}.", "Metrics in the evidence are final: do not calculate or estimate any.", "Answer in Markdown only."]
    return "\n".join([f"Section: {section}", f"Quarter: {quarter}", task, *(f"- {r}" for r in rules), "", f"Request: {wish}", "", "Evidence:", blocks])


def params_hash(model: str) -> str:
    """Identity of what a text was generated with."""
    # fixed values: the fields in their order
    return hashlib.sha256(json.dumps({"v": 1, "api": "/api/generate", "model": model, "stream": False}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def checked(drafts: DataFrame, by: str = "bullet") -> DataFrame:
    """drafts (``text, allowed``: ids of the chosen chunks) plus ``cited`` and the first ``fault``: a text has to cite, in every bullet or paragraph, and
    allowed chunks only.  A fault has ``code, message, details``."""
    fault = lambda code, message, details: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), details.alias("details"))
    none = F.lit(None).cast("string")
    bare = evidence.uncited(F.col("text"), by)
    out = drafts.withColumn("cited", evidence.cited(F.col("text")))
    other = F.array_except("cited", "allowed")
    first = (
        F.when(~F.contains("text", F.lit(MARK)), fault("AI_CITATION_REQUIRED", "The draft has no citation", none))
        .when(F.size(bare) > 0, fault("AI_CITATION_REQUIRED", f"A {by} has no citation", F.array_join(F.transform(bare, lambda x: x.cast("string")), ",")))
        .when(F.size(other) > 0, fault("AI_CITATION_INVALID", "A citation is not among the chosen evidence", F.array_join(other, ",")))
    )
    return out.withColumn("fault", first)


def check(text: str, allowed: list[str], by: str = "bullet") -> list[str]:
    """The cited ids of one text; a fault is an error."""
    one = SparkSession.active().createDataFrame([(text, allowed)], "text string, allowed array<string>")
    r = checked(one, by).first()
    if r["fault"]:
        raise TidelogError(*r["fault"])
    return r["cited"]


def draft(chunk_table: DataFrame, chosen: list[str], section: str, quarter: str, wish: str, generate: Callable[[str], str]) -> dict:
    spark = chunk_table.sparkSession
    if not chosen:
        raise TidelogError("AI_CITATION_REQUIRED", "Choose at least one chunk of evidence")
    known = {r["chunk_id"] for r in chunk_table.filter(F.col("chunk_id").isin(*chosen)).select("chunk_id").distinct().collect()}  # chosen by hand
    for missing in (x for x in chosen if x not in known):
        raise TidelogError("AI_CITATION_INVALID", "A chosen chunk does not exist", f"chunk_id={missing}")
    order = spark.createDataFrame(list(enumerate(dict.fromkeys(chosen))), "pos int, chunk_id string")
    blocks = evidence.evidence_blocks(chunk_table, order).first()["blocks"]
    text = generate(prompt(section, quarter, wish, blocks))
    return {"text": text, "citations": check(text, chosen, "paragraph" if section == "quarter_narrative_recap" else "bullet")}


def loopback(url: str) -> bool:
    """Whether a model server's address is plain loopback: ``http://127.0.0.1[:port]`` and nothing else."""
    m = re.fullmatch(r"http://127\.0\.0\.1(?::(\d{1,5}))?/?", url)
    return bool(m) and (m[1] is None or 1 <= int(m[1]) <= 65535)


#: What to do about an error, by its code.
GUIDANCE = {
    "WORKSPACE_NOT_FOUND": "Choose a folder that holds a workspace, or create one.",
    "WORKSPACE_EXISTS": "Open the workspace, or choose an empty folder.",
    "WORKSPACE_MOVE_FAILED": "Check that the folder can be written, then try again.",
    "WORKSPACE_COPY_FAILED": "Check that both folders can be reached, then try again.",
    "WORKSPACE_CONFLICT": "Someone else changed the same tables; look at the new state, then try again.",
    "WORKSPACE_MIGRATION_PENDING": "Agree to the schema steps, or open the workspace with the version that wrote it.",
    "INGEST_CSV_RANGES_CHANGED": "Import again without changing how Spark cuts files meanwhile.",
    "DB_AI_DRAFT_CREATE_FAILED": "The draft is stored already; open that one.",
    "SHARED_FOLDER_MISSING": "Set spark.checkpoint.dir to a folder that all executors share.",
    "INGEST_SANITIZED_DB_NOT_EMPTY": "Import into a new, empty workspace.",
    "INGEST_SANITIZED_MANIFEST_VERSION": "The export is of another version; make it again with this one.",
    "INGEST_SANITIZED_FILE_MISSING": "The export is not whole; ask for a fresh one.",
    "INGEST_SANITIZED_HASH_MISMATCH": "The export was changed after it was written; ask for a fresh one.",
    "INGEST_SANITIZED_SIZE_MISMATCH": "The export was changed after it was written; ask for a fresh one.",
    "INGEST_SANITIZED_METRICS_MISMATCH": "The export contradicts itself; make it again, and if that does not help take it as damaged.",
    "AI_MODEL_UNREACHABLE": "Start the model server on this machine, then try again.",
    "AI_EVIDENCE_EMPTY": "Add a source of evidence first.",
    "AI_EVIDENCE_SOURCE_INVALID": "Check that the path exists and suits the type of source.",
    "AI_EVIDENCE_NOT_FOUND": "Build the chunks again; the one asked for is gone.",
    "AI_INDEX_NOT_READY": "Build the chunks, then the index.",
    "AI_INDEX_BUILD_FAILED": "Build the index anew with one model for all chunks.",
    "AI_RETRIEVAL_FAILED": "Ask a question that is not empty, with the model that the index was built with.",
    "AI_CITATION_REQUIRED": "Choose evidence, and ask again for a text that cites it.",
    "AI_CITATION_INVALID": "Ask again; the text may cite nothing but the chosen evidence.",
}


def guidance(code: str) -> str | None:
    return GUIDANCE.get(code)


def ladder(healthy: bool | None, sources: int, chunks: int, indexed: bool | None, chosen: int) -> dict:
    """What can be done with the evidence so far, and the first thing that is missing for a draft, by its code."""
    one = SparkSession.active().createDataFrame([(healthy, sources, chunks, indexed, chosen)], "healthy boolean, sources long, chunks long, indexed boolean, chosen long")
    return ladder_of(one).select("can_search", "can_draft", "missing").first().asDict()


#: What a draft needs, in this order: the code of what is missing, and the condition; what isn't known yet doesn't hold anyone up.
LADDER = [("AI_MODEL_UNREACHABLE", "coalesce(healthy, true)"), ("AI_EVIDENCE_EMPTY", "sources > 0"), ("AI_INDEX_NOT_READY", "chunks > 0 AND coalesce(indexed, true)")]


def ladder_of(states: DataFrame) -> DataFrame:
    """states (``healthy, sources, chunks, indexed, chosen``) plus ``can_search, can_draft, missing``."""
    out = gate(states, LADDER).withColumn("can_search", F.col("blocked_by").isNull() & F.coalesce(F.col("healthy") & F.col("indexed"), F.lit(False)))
    out = out.withColumn("can_draft", F.col("can_search") & (F.col("chosen") > 0))
    return out.withColumn("missing", F.coalesce("blocked_by", F.when(~F.col("can_draft"), "AI_CITATION_REQUIRED"))).drop("blocked_by")


def embedding_models(names: list[str]) -> list[str]:
    return [n for n in names if "embed" in n]


def drafting_models(names: list[str]) -> list[str]:
    return [n for n in names if "embed" not in n]
