"""Draft artifacts: checks, hashes and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.errors import TidelogError
from tidelog.operators import tables

#: The kinds of sections.
SECTIONS = ("exec_summary", "incident_highlights_top_n", "theme_analysis", "action_plan_next_quarter", "quarter_narrative_recap")
#: The fields that identify a draft, in the order in which they are hashed.
HASHED = ("quarter_label", "section_type", "draft_text", "citation_chunk_ids", "model_name", "model_params_hash", "prompt_template_version", "created_at")


def section(c: Column) -> Column:
    """The kind, if it is one, else null."""
    return F.when(c.isin(*SECTIONS), c)


def fault() -> Column:
    """Why a new draft cannot be stored: ``code, message`` of its first failing check, null for a sound one."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
    return (
        F.when(F.coalesce(F.size("citation_chunk_ids"), F.lit(0)) <= 0, error("AI_CITATION_REQUIRED", "A draft needs a citation"))
        .when(blank("quarter_label"), error("DB_AI_DRAFT_INVALID", "quarter_label is missing"))
        .when(blank("draft_text"), error("DB_AI_DRAFT_INVALID", "draft_text is missing"))
        .when(blank("model_name") | blank("model_params_hash") | blank("prompt_template_version"), error("DB_AI_DRAFT_INVALID", "Model metadata is missing"))
        .when(section(F.col("section_type")).isNull(), error("DB_AI_DRAFT_INVALID", "section_type is unknown"))
    )


def valid(drafts: DataFrame) -> DataFrame:
    return drafts.filter(fault().isNull())


def artifact_hash() -> Column:
    return F.sha2(F.to_json(F.struct(*HASHED)), 256)


def create(new: DataFrame, existing: DataFrame, copies: bool = False) -> DataFrame:
    """The table with new drafts: checked, hashed, numbered in their chains, with ids from the largest on in the order of ``created_at``, hash and the ids they come with.

    A hash is stored once: a draft that is there already, or twice among the new ones, is an error (``not_known`` leaves those out).  Called inside
    ``Workspace.update`` this holds for several writers too.  With ``copies`` drafts of one content that come together are all stored, each with an id of
    its own; one that is there already is an error still, so nothing that came is stored a second time.
    """
    wrong = new.select(fault().alias("e")).filter("e is not null").limit(1).collect()
    if wrong:
        raise TidelogError(wrong[0]["e"]["code"], wrong[0]["e"]["message"])
    hashed = with_revisions(new.withColumn("artifact_hash", artifact_hash()), existing)
    again = existing.select("artifact_hash").join(hashed.select("artifact_hash").distinct(), "artifact_hash", "left_semi")
    if not copies:
        again = again.unionByName(hashed.groupBy("artifact_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("artifact_hash"))
    repeat = again.first()
    if repeat:
        raise TidelogError("DB_AI_DRAFT_CREATE_FAILED", "A draft with this content is stored already", f"artifact_hash={repeat['artifact_hash']}")
    return existing.unionByName(tables.next_ids(hashed, existing, [F.col(c) for c in ("created_at", "artifact_hash", "id") if c in hashed.columns]).select(*existing.columns))


def get(drafts: DataFrame, draft_id: int) -> DataFrame:
    """One draft; an unknown id is an error."""
    found = drafts.filter(F.col("id") == draft_id)
    if found.isEmpty():
        raise TidelogError("DB_NOT_FOUND", "There is no such draft", f"id={draft_id}")
    return found


def listed(drafts: DataFrame, quarter: str | None = None) -> DataFrame:
    rows = drafts if quarter is None else drafts.filter(F.col("quarter_label") == quarter)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def lineage(drafts: DataFrame) -> DataFrame:
    """``id, root_id, depth`` (0 at the root) of every draft whose chain of parents is whole; drafts in a ring or without a known root are left out."""
    return _walked(drafts).filter("done").select("id", F.col("up").alias("root_id"), F.col("steps").cast("int").alias("depth"))


def rings(drafts: DataFrame) -> DataFrame:
    """``id, code``: drafts whose parents lead round in a ring, or into one."""
    return _walked(drafts).filter("not done").select("id", F.lit("DB_AI_DRAFT_RING").alias("code"))


def ancestors(drafts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``id, position, ancestor_id``: the path from the root (position 0) to each draft itself, or to those whose ``id`` is in ``only``.

    Ancestors 1, 2, 4, ... levels up are tables; each round puts those of one more distance behind all that are known, so every row of the result is made
    once, in as many rounds as the depth has binary digits.  Drafts without a whole chain are left out.
    """
    whole = durable.written(lineage(drafts).select("id", "depth"))
    chosen = whole if only is None else whole.join(only.select("id").distinct(), "id", "left_semi")
    above = durable.written(drafts.filter("parent_draft_id is not null").select("id", F.col("parent_draft_id").alias("up")).join(whole.select("id"), "id", "left_semi"))
    paths, step = durable.written(chosen.select("id", "depth", F.lit(0).alias("distance"), F.col("id").alias("ancestor_id"))), 1
    while True:
        more = durable.written(paths.join(above.select(F.col("id").alias("ancestor_id"), "up"), "ancestor_id").select("id", "depth", (F.col("distance") + step).alias("distance"), F.col("up").alias("ancestor_id")))
        if more.isEmpty():
            break
        paths, step = paths.unionByName(more), step * 2
        above = durable.written(above.join(above.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
    return paths.select("id", (F.col("depth") - F.col("distance")).alias("position"), "ancestor_id")


def _walked(drafts: DataFrame) -> DataFrame:
    """Every draft followed up its parents by pointer jumping: each round doubles the reach, so a chain of a million takes twenty.

    ``done`` are those at a root; drafts in a ring never arrive, those without a known root go.
    """
    state = durable.written(drafts.select("id", F.coalesce("parent_draft_id", "id").alias("up"), F.when(F.col("parent_draft_id").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("parent_draft_id").isNull().alias("done")))
    # a chain has fewer steps than there are drafts
    for _ in range(state.count().bit_length()):
        if state.filter("not done").isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("done").alias("arrived"))
        moved = state.filter("not done").join(above, "up").select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("arrived").alias("done"))
        state = durable.written(state.filter("done").unionByName(moved))
    return state


def siblings(drafts: DataFrame) -> DataFrame:
    """``id, sibling_id, position``: other drafts of the same parent, by revision and id, from 1."""
    a = drafts.filter("parent_draft_id is not null").select("id", "parent_draft_id")
    place = F.row_number().over(Window.partitionBy("parent_draft_id").orderBy("revision_number", "id"))
    b = drafts.filter("parent_draft_id is not null").select(F.col("id").alias("sibling_id"), "parent_draft_id", place.alias("place"))
    own = b.select(F.col("sibling_id").alias("id"), F.col("place").alias("own"))
    pairs = a.join(b, "parent_draft_id").filter("id <> sibling_id").join(own, "id")
    return pairs.select("id", "sibling_id", (F.col("place") - (F.col("place") > F.col("own")).cast("int")).alias("position"))


def children(drafts: DataFrame) -> DataFrame:
    return drafts.filter("parent_draft_id is not null").select(F.col("parent_draft_id").alias("id"), F.col("id").alias("child_id"))


def with_revisions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New drafts with revision numbers: the parent's plus one, 1 without a parent; unknown parents are an error."""
    parents = existing.select(F.col("id").alias("parent_draft_id"), F.col("revision_number").alias("__rev"))
    out = new.drop("revision_number").join(parents, "parent_draft_id", "left")
    if not out.filter("parent_draft_id is not null and __rev is null").isEmpty():
        raise TidelogError("DB_NOT_FOUND", "A parent draft does not exist")
    return out.withColumn("revision_number", (F.coalesce("__rev", F.lit(0)) + 1).cast("int")).drop("__rev")


def not_known(new: DataFrame, existing: DataFrame, by: tuple[str, ...] = ("artifact_hash",)) -> DataFrame:
    """New drafts whose hash is not there yet, each once (the one with the smallest id, if they have ids).  Where drafts of one content are drafts of
    their own, ``by`` names all that tells drafts apart: id and hash."""
    once = tables.first_of(new, [*by], [F.col("id").asc_nulls_last(), F.col("created_at")], exempt_null=False)
    return once.join(existing.select(*by), [*by], "left_anti")
