"""Backups of a workspace: a copy of each table's current version, a manifest with counts and hashes, and restore."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.errors import TidelogError
from tidelog.schema import TABLES
from tidelog.sources.workspace import Files, Workspace, tree_hashes

VERSION = 1


def _table_hash(spark: SparkSession, path: str, name: str) -> str:
    """An order-free hash of a table's rows: the sum of the rows' 64-bit hashes, and their number."""
    rows = spark.read.schema(TABLES[name]).parquet(path)
    text = F.to_json(F.struct("*"))
    r = rows.agg(F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{r['n']}:{r['h'] or 0}"


def create(w: Workspace, folder: str, export_time: str, app_version: str, artifacts: str | None = None) -> dict:
    """A copy of every table, and of a folder of artifact files if one is given, with a manifest."""
    files = Files(w.spark, folder)
    if files.exists("manifest.json"):
        raise TidelogError("BACKUP_EXISTS", "There is a backup already", folder)
    hashes = {}
    for name in TABLES:
        w.table(name).write.mode("errorifexists").parquet(f"{folder}/{name}")
        hashes[name] = _table_hash(w.spark, f"{folder}/{name}", name)
    manifest = {"version": VERSION, "app_version": app_version, "export_time": export_time, "steps": w.applied(), "counts": w.counts(), "hashes": hashes}
    if artifacts is not None:
        files.copy(artifacts, "files")
        manifest["files"] = tree_hashes(w.spark, f"{folder}/files")
        if manifest["files"] != tree_hashes(w.spark, artifacts):
            raise TidelogError("BACKUP_COPY_FAILED", "A file changed while it was copied", artifacts)
    files.write(json.dumps(manifest, indent=2, sort_keys=True), "manifest.json")
    return manifest


def inspect(spark: SparkSession, folder: str) -> dict:
    files = Files(spark, folder)
    if not files.exists("manifest.json"):
        raise TidelogError("BACKUP_MANIFEST_MISSING", "There is no manifest", folder)
    return json.loads(files.read("manifest.json"))


def restore(spark: SparkSession, folder: str, target: str, allow_overwrite: bool = False) -> Workspace:
    """The backup as a workspace, after checks; a workspace in its place is kept beside it as ``.pre_restore``."""
    manifest = inspect(spark, folder)
    if manifest["version"] != VERSION:
        raise TidelogError("RESTORE_VERSION", "Unknown backup version", str(manifest["version"]))
    for name, h in manifest["hashes"].items():
        if _table_hash(spark, f"{folder}/{name}", name) != h:
            raise TidelogError("RESTORE_HASH_MISMATCH", "A table is not as listed", name)
    if "files" in manifest and tree_hashes(spark, f"{folder}/files") != manifest["files"]:
        raise TidelogError("RESTORE_HASH_MISMATCH", "An artifact file is not as listed", "files")
    parent, _, leaf = target.rstrip("/").rpartition("/")
    files = Files(spark, parent)
    if files.exists(leaf, "pointer.json") and not allow_overwrite:
        raise TidelogError("RESTORE_TARGET_EXISTS", "There is a workspace already", target)
    stage = Workspace.create(spark, f"{parent}/.{leaf}.stage")
    for name in TABLES:
        stage.replace(name, spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}"))
    if "files" in manifest:
        stage.files.copy(f"{folder}/files", "files")
    old = files.exists(leaf)
    if old:
        files.delete(f"{leaf}.pre_restore")
        files.move((leaf,), (f"{leaf}.pre_restore",))
    try:
        files.move((f".{leaf}.stage",), (leaf,))
    except Exception:
        if old:
            files.move((f"{leaf}.pre_restore",), (leaf,))
        raise
    return Workspace.open(spark, target)
