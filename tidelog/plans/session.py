"""One entry to all that a user of the review does: each call is a step on the tables of the open workspace.

Models are callables that the caller brings, and the time is an argument, so every step can be repeated with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.errors import TidelogError
from tidelog.functions import incident as inc
from tidelog.operators import drafts as dr
from tidelog.operators import evidence as ev
from tidelog.operators import tables as tb
from tidelog.plans import backup, dashboard, drafting, importing, report, sanitizing
from tidelog.schema import DRAFT
from tidelog.sources import demo, issues_csv, transcripts
from tidelog.sources.workspace import Changed, Snapshot, Workspace

#: Workspaces that are remembered; chunks and drafts that a list shows at once.
RECENT, SHOWN_CHUNKS, SHOWN_DRAFTS = 8, 50, 25


class Session:
    def __init__(self, spark: SparkSession, recent: tuple[str, ...] = ()):
        self.spark, self.recent = spark, list(recent)
        self._open: Workspace | None = None
        self._cache = dashboard.Cache()

    @property
    def workspace(self) -> Workspace:
        if self._open is None:
            raise TidelogError("WORKSPACE_NOT_FOUND", "No workspace is open")
        return self._open

    def _use(self, w: Workspace) -> Workspace:
        self._open = w
        self.recent = [w.root, *(x for x in self.recent if x != w.root)][:RECENT]
        self._cache.invalidate()
        return w

    def create(self, root: str) -> Workspace:
        return self._use(Workspace.create(self.spark, root))

    def open(self, root: str, migrate: bool = False) -> Workspace:
        """A workspace that lacks schema steps is an error unless the user has agreed to apply them."""
        return self._use(Workspace.open(self.spark, root, migrate))

    def load_all(self, root: str, now: float = 0.0, migrate: bool = False) -> dict:
        """Opens a workspace and reads what the first page shows, in that order: incidents, dashboard, validation, report."""
        self.open(root, migrate)
        return {"incidents": self.incidents()[0], "dashboard": self.dashboard(now=now), "validation": self.validation(), "report": self.report()}

    # incidents

    def seed_demo(self) -> int:
        if not self.workspace.is_empty():
            raise TidelogError("DEMO_NOT_EMPTY", "The demonstration set needs an empty workspace")
        self.workspace.update(lambda at: {"incidents": demo.incidents(self.spark)})
        return self.workspace.counts()["incidents"]

    def import_csv(self, path: str, mapping: Mapping[str, str | None] | int) -> dict:
        """Imports by a mapping, or by the id of a stored profile."""
        if isinstance(mapping, int):
            found = self.workspace.profiles().filter(F.col("id") == mapping).first()
            if found is None:
                raise TidelogError("PROFILE_NOT_FOUND", "There is no such profile", str(mapping))
            mapping = found["mapping"]
        cells = issues_csv.mapped(issues_csv.read_ranges(self.spark, path), issues_csv.header(self.spark, path), mapping)
        out: dict[str, int] = {}

        def upsert(at: Snapshot) -> dict:
            result = importing.upsert(issues_csv.staged(cells), at.table("incidents"))
            out.update(result.summary())
            changes = durable.written(result.changes)
            return {"incidents": Changed(changes, changes.select("id"))}

        self.workspace.update(upsert)
        return out

    def preview_csv(self, path: str, max_rows: int = 20) -> tuple[list[str], list[list[str]]]:
        return issues_csv.preview(self.spark, path, max_rows)

    def incidents(self, limit: int = tb.PAGE, offset: int = 0, sort: str | None = None, descending: bool = False) -> tuple[DataFrame, dict]:
        return tb.page(self.workspace.table("incidents"), limit, offset, sort, descending)

    def incident(self, incident_id: int) -> DataFrame:
        one = self.workspace.table("incidents").filter(F.col("id") == incident_id)
        if one.isEmpty():
            raise TidelogError("DB_NOT_FOUND", "There is no such incident", f"id={incident_id}")
        return tb.detail(one, self.workspace.table("artifacts"), self.workspace.table("timeline_events"))

    def validation(self) -> DataFrame:
        rows = self.workspace.table("incidents").withColumn("warnings", inc.validation_warnings())
        return rows.filter(F.size("warnings") > 0).select("id", "external_id", "title", "warnings").orderBy(*inc.canonical_order())

    def dashboard(self, version: int = 2, now: float = 0.0) -> dict:
        at = self.workspace.snapshot()
        return self._cache.get(at.table("incidents"), version, now, at.key("incidents"))

    def report(self) -> str:
        return report.markdown(self.workspace.table("incidents"))

    # transcripts

    def preview_transcript(self, text: str) -> DataFrame:
        return transcripts.preview(self.spark.createDataFrame([("chat", text)], "source_id string, text string"))

    def ingest_transcript(self, text: str, created_at: str, incident_id: int | None = None, title: str | None = None) -> DataFrame:
        """Adds the messages; its warnings come back."""
        found: list[DataFrame] = []

        def ingest(at: Snapshot) -> dict:
            incidents, events, warnings = transcripts.ingest(text, at.table("incidents"), at.table("timeline_events"), created_at, incident_id, title)
            found[:] = [warnings]
            return {"timeline_events": events} | ({"incidents": incidents} if title is not None else {})

        self.workspace.update(ingest)
        return found[0]

    # evidence

    def add_source(self, source_type: str, origin_kind: str, label: str, created_at: str, path: str | None = None, text: str | None = None) -> str:
        new = ev.new_source(self.spark, source_type, origin_kind, label, created_at, path, text)
        self.workspace.update(lambda at: {"sources": ev.register(at.table("sources"), new)})
        return new.first()["source_id"]

    def build_chunks(self, source: str | None = None) -> int:
        """Chunks of all sources anew, or of one, of which only its part of the table is written; the number of chunks."""

        def build(at: Snapshot) -> dict:
            made = ev.rebuild(self.spark, at.table("sources"), None, lambda folder: sanitizing.read(self.spark, folder), source)
            return {"chunks": made if source is None else Changed(made, self.spark.createDataFrame([(source,)], "source_id string"))}

        self.workspace.update(build)
        return self.workspace.table("chunks").count()

    def chunks(self, limit: int = SHOWN_CHUNKS, offset: int = 0, source: str | None = None) -> tuple[DataFrame, dict]:
        return ev.chunk_page(self.workspace.table("chunks"), limit, offset, source)

    def chunk(self, chunk_id: str) -> DataFrame:
        return ev.chunk(self.workspace.table("chunks"), chunk_id)

    def context(self, chunk_id: str, window: int) -> DataFrame:
        c = self.workspace.table("chunks")
        near = ev.context(c, self.chunk(chunk_id), window)
        return ev.listing(c.join(near.select("chunk_id"), "chunk_id", "left_semi"))

    def index_status(self) -> ev.IndexStatus:
        return ev.read_status(self.workspace.files)

    def build_index(self, embed: ev.Embedder, model: str, updated_at: str, source: str | None = None) -> ev.IndexStatus:
        w = self.workspace
        made: list[ev.IndexStatus] = []

        def build(at: Snapshot) -> dict:
            vectors, status = ev.refresh_index(at.table("chunks"), at.table("vectors"), self.index_status(), embed, model, updated_at, source)
            made[:] = [status]
            return {"vectors": vectors}

        w.update(build)
        ev.write_status(w.files, made[0])
        return made[0]

    def ask(self, embed: ev.Embedder, question: str, k: int = 10, sources: list[str] | None = None) -> DataFrame:
        w = self.workspace
        return ev.retrieve(w.table("chunks"), w.table("vectors"), self.index_status(), embed, question, k, sources)

    def gate(self, healthy: bool | None, chosen: int) -> dict:
        w = self.workspace
        return drafting.ladder(healthy, w.table("sources").count(), w.table("chunks").count(), self.index_status().ready, chosen)

    # drafts

    def write_draft(self, chosen: list[str], section: str, quarter: str, wish: str, generate: Callable[[str], str], model: str, created_at: str, parent: int | None = None) -> int:
        """Generates, checks and stores a section; its id."""
        made = drafting.draft(self.workspace.table("chunks"), chosen, section, quarter, wish, generate)
        row = dict.fromkeys(DRAFT.fieldNames()) | {"quarter_label": quarter, "section_type": section, "draft_text": made["text"], "citation_chunk_ids": made["citations"], "model_name": model, "model_params_hash": drafting.params_hash(model), "prompt_template_version": "v1", "created_at": created_at, "parent_draft_id": parent}
        new = self.spark.createDataFrame([row], DRAFT)
        ids: list[int] = []

        def create(at: Snapshot) -> dict:
            drafts = durable.written(dr.create(new, at.table("drafts")))
            ids[:] = [drafts.agg(F.max("id")).first()[0]]
            return {"drafts": drafts}

        self.workspace.update(create)
        return ids[0]

    def drafts(self, quarter: str | None = None, limit: int = SHOWN_DRAFTS) -> DataFrame:
        return dr.listed(self.workspace.table("drafts"), quarter).limit(limit)

    def draft(self, draft_id: int) -> DataFrame:
        return dr.get(self.workspace.table("drafts"), draft_id)

    # whole workspaces

    def backup(self, folder: str, export_time: str, app_version: str, artifacts: str | None = None) -> dict:
        return backup.create(self.workspace, folder, export_time, app_version, artifacts)

    def restore(self, folder: str, target: str, allow_overwrite: bool = False) -> Workspace:
        return self._use(backup.restore(self.spark, folder, target, allow_overwrite))

    def export_sanitized(self, folder: str, export_time: str, app_version: str) -> dict:
        return sanitizing.export(self.spark, self.workspace.table("incidents"), self.workspace.table("timeline_events"), folder, export_time, app_version)

    def import_sanitized(self, folder: str) -> list[dict]:
        """Fills an empty workspace from an export; what was lost on the way comes back as notes."""
        found: list[list[dict]] = []

        def fill(at: Snapshot) -> dict:
            empty = all(at.table(n).isEmpty() for n in ("incidents", "timeline_events", "artifacts"))
            incidents, events, notes = sanitizing.restore(self.spark, folder, empty)
            found[:] = [notes]
            return {"incidents": incidents, "timeline_events": events}

        self.workspace.update(fill)
        return found[0]
