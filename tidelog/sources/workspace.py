"""A workspace: a directory of Parquet tables in versions.

Writers never change a file that a version lists, so readers see one version and a failed write leaves the old one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import TidelogError
from tidelog.schema import STEPS, TABLES


class Files:
    """Small files and folders by Hadoop path, so any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def write(self, text: str, *parts: str) -> None:
        out = self.fs.create(self.at(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def put(self, text: str, *parts: str) -> None:
        """Writes aside and renames over the old file, so a reader or a crash meets the old text or the new one."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        aside = (*parts[:-1], f".{parts[-1]}.new")
        self.write(text, *aside)
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self.fs.getUri(), conf).rename(self.at(*aside), self.at(*parts), how)

    def put_new(self, text: str, *parts: str) -> bool:
        """Creates a file with this text, whole at once; False if there is one by that name already.  Of several writers one succeeds."""
        aside = (*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        if self.fs.getUri().getScheme() == "file":  # Hadoop's rename of local files is not one step
            a, b = (self.at(*x).toUri().getPath() for x in (aside, parts))
            os.makedirs(os.path.dirname(a), exist_ok=True)
            with open(a, "w") as f:
                f.write(text)
            try:
                os.link(a, b)
            except FileExistsError:
                return False
            finally:
                os.unlink(a)
            return True
        self.write(text, *aside)
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), conf).rename(self.at(*aside), self.at(*parts), how)
        except Py4JJavaError as e:
            self.fs.delete(self.at(*aside), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def children(self, *parts: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(*parts))) if self.exists(*parts) else []

    def read(self, *parts: str) -> str:
        rows = self.spark.read.text(str(self.at(*parts)), wholetext=True).collect()
        return rows[0][0] if rows else ""

    def copy(self, source: str, *parts: str) -> None:
        """A file or folder with all that is in it, from anywhere that Spark reads."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        src = self._path(source)
        if not hadoop.FileUtil.copy(src.getFileSystem(conf), src, self.fs, self.at(*parts), False, conf):
            raise TidelogError("WORKSPACE_COPY_FAILED", "Could not copy", source)

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def move(self, a: tuple[str, ...], b: tuple[str, ...]) -> None:
        if not self.fs.rename(self.at(*a), self.at(*b)):
            raise TidelogError("WORKSPACE_MOVE_FAILED", "Could not move", f"{a} -> {b}")


#: Tables that are kept in parts by a hash of a column, so that a change of few keys rewrites few parts; how many parts.
KEYED = {"incidents": "id", "chunks": "source_id"}
PARTS = 16
CONFLICT = "WORKSPACE_CONFLICT"


@dataclass
class Changed:
    """New rows for some keys of a keyed table: whatever is stored under ``keys`` goes, ``rows`` come."""

    rows: DataFrame
    keys: DataFrame  # one column


class Snapshot:
    """The workspace at one version.  What is read through it is remembered, so that a commit can tell whether it still holds."""

    def __init__(self, workspace: Workspace, version: int):
        self.workspace, self.version = workspace, version
        self.state = workspace.state(version)
        self.reads: set[str] = set()

    def table(self, name: str) -> DataFrame:
        self.reads.add(name)
        return self.workspace.load(name, self.state["tables"][name])

    def key(self, name: str) -> str:
        """Stands for the rows of a table: tables with equal keys are the same files."""
        return json.dumps(self.state["tables"][name], sort_keys=True)


class Workspace:
    """Versions are files ``log/<number>.json`` that list every table's folders.  A commit writes new folders, then creates the file of
    the next version, which only one writer can.  One that comes too late looks at what the others changed: if that touches a table
    that it read or writes, the commit fails with ``WORKSPACE_CONFLICT``; else it goes on behind them.  ``update`` tries again from the newest
    version.  ``pointer.json`` marks the folder as a workspace and never changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = root.rstrip("/")
        self._seen: dict[str, int] = {}
        self._newest = 0

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Workspace:
        w = cls(spark, root)
        if w.files.exists("pointer.json"):
            raise TidelogError("WORKSPACE_EXISTS", "There is a workspace already", root)
        tables = {name: w._empty(name) for name in TABLES}
        if not w.files.put_new(json.dumps({"steps": list(STEPS), "tables": tables, "changed": sorted(tables)}), *w._log(1)):
            raise TidelogError("WORKSPACE_EXISTS", "There is a workspace already", root)
        w.files.put("{}", "pointer.json")
        return w

    @classmethod
    def open(cls, spark: SparkSession, root: str, migrate: bool = False) -> Workspace:
        """An existing workspace; one that lacks schema steps only if the caller agrees to apply them."""
        w = cls(spark, root)
        if not w.files.exists("pointer.json"):
            raise TidelogError("WORKSPACE_NOT_FOUND", "There is no workspace", root)
        if not migrate and (todo := w.pending()):
            raise TidelogError("WORKSPACE_MIGRATION_PENDING", "The workspace needs schema steps first", ", ".join(todo))
        w.migrate()
        return w

    # versions

    @staticmethod
    def _log(version: int) -> tuple[str, str]:
        return "log", f"{version:012d}.json"

    def state(self, version: int) -> dict:
        return json.loads(self.files.read(*self._log(version)))

    def latest(self) -> int:
        """The newest version: from the last that this object met on, at first from a list of the log."""
        self._newest = self._newest or max(int(n.split(".")[0]) for n in self.files.children("log") if n[0] != ".")
        while self.files.exists(*self._log(self._newest + 1)):
            self._newest += 1
        return self._newest

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.latest())

    def _empty(self, name: str) -> dict:
        return {"parts": {}, "n": PARTS} if name in KEYED else {"folder": None}

    def load(self, name: str, entry: dict) -> DataFrame:
        folders = list(entry["parts"].values()) if "parts" in entry else [entry["folder"]] * (entry["folder"] is not None)
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def _write(self, name: str, rows: DataFrame | Changed, entry: dict) -> dict:
        """New folders with a table's rows, or with those parts that a change touches; the table's entry."""
        folder, fields = f"{name}/{uuid.uuid4().hex}", TABLES[name].fieldNames()
        if name not in KEYED:
            rows.select(*fields).write.parquet(f"{self.root}/{folder}")
            return {"folder": folder}
        n, parts, key = entry["n"], {}, KEYED[name]
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
        if isinstance(rows, Changed):
            keys = rows.keys.select(F.col(rows.keys.columns[0]).alias("__key")).unionByName(rows.rows.select(F.col(key).alias("__key"))).distinct()
            touched = {str(r["p"]) for r in keys.select(part("__key").alias("p")).distinct().collect()}  # n at most
            parts = {p: f for p, f in entry["parts"].items() if p not in touched}
            held = self.load(name, {"parts": {p: f for p, f in entry["parts"].items() if p in touched}})
            rows = held.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti").select(*fields).unionByName(rows.rows.select(*fields))
        # large parts are split over tasks, small ones are one file
        rows.select(*fields, part(key).alias("__part")).hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{self.root}/{folder}")
        for child in self.files.children(folder):
            if child.startswith("__part="):
                parts[child.split("=")[1]] = f"{folder}/{child}"
        return {"parts": parts, "n": n}

    def commit(self, base: Snapshot, changes: Mapping[str, DataFrame | Changed], steps: list[str] | None = None) -> int:
        """Writes tables as they follow from a snapshot; the new version's number.  Nothing that others wrote since is lost."""
        written = {name: self._write(name, rows, base.state["tables"].get(name) or self._empty(name)) for name, rows in changes.items()}
        state, version = base.state, base.version
        while True:
            version += 1
            new = {"steps": steps or state["steps"], "tables": state["tables"] | written, "changed": sorted(written)}
            if self.files.put_new(json.dumps(new), *self._log(version)):
                self._seen |= dict.fromkeys(written, version)
                return version
            state = self.state(version)
            lost = set(state["changed"]) & (base.reads | set(written))
            if lost or steps:
                raise TidelogError(CONFLICT, "Another writer changed what this change is made from", ", ".join(sorted(lost)) or "steps")

    def update(self, build: Callable[[Snapshot], Mapping[str, DataFrame | Changed]], attempts: int = 8) -> int:
        """Commits what ``build`` makes of the newest version, again from the next newest if another writer was faster."""
        for left in reversed(range(attempts)):
            base = self.snapshot()
            try:
                return self.commit(base, build(base))
            except TidelogError as e:
                if e.code != CONFLICT or not left:
                    raise
        raise AssertionError

    def table(self, name: str) -> DataFrame:
        base = self.snapshot()
        self._seen[name] = base.version
        return base.table(name)

    def replace(self, name: str, rows: DataFrame) -> None:
        """A whole new table; a conflict if it changed since this workspace object last read it."""
        base = Snapshot(self, self._seen.get(name) or self.latest())
        base.reads.add(name)
        self.commit(base, {name: rows})

    def append(self, name: str, rows: DataFrame) -> None:
        self.update(lambda at: {name: at.table(name).unionByName(rows.select(*TABLES[name].fieldNames()))})

    # schema steps

    def applied(self) -> list[str]:
        return self.snapshot().state["steps"]

    def pending(self) -> list[str]:
        """Schema steps not applied yet: all less the applied ones, in order."""
        names = lambda xs: self.spark.createDataFrame([(x,) for x in xs], "name string")
        return [r["name"] for r in names(STEPS).join(names(self.applied()), "name", "left_anti").orderBy("name").collect()]

    def migrate(self) -> list[str]:
        todo = self.pending()
        if todo:
            base = self.snapshot()
            new = {name: self.spark.createDataFrame([], TABLES[name]) for name in TABLES.keys() - base.state["tables"].keys()}
            self.commit(base, new, sorted({*base.state["steps"], *todo}))
        return todo

    def counts(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in ("incidents", "timeline_events", "artifacts")}

    def is_empty(self) -> bool:
        return all(self.table(n).isEmpty() for n in ("incidents", "timeline_events", "artifacts"))

    # mapping profiles

    def profiles(self) -> DataFrame:
        return self.table("profiles").orderBy("name", "id")

    def put_profile(self, name: str, mapping: dict[str, str], profile_id: int | None = None) -> int:
        if not mapping.get("title") or not name.strip():
            raise TidelogError("PROFILE_INVALID", "A profile needs a name and a title column")
        given = profile_id

        def put(at: Snapshot) -> dict:
            nonlocal profile_id
            rows = at.table("profiles")
            if given is None:
                profile_id = (rows.agg(F.max("id")).first()[0] or 0) + 1
            elif rows.filter(F.col("id") == given).isEmpty():
                raise TidelogError("PROFILE_NOT_FOUND", "There is no such profile", str(given))
            new = self.spark.createDataFrame([(profile_id, name, mapping)], TABLES["profiles"])
            return {"profiles": rows.filter(F.col("id") != profile_id).unionByName(new)}

        self.update(put)
        return profile_id

    def drop_profile(self, profile_id: int) -> None:
        def drop(at: Snapshot) -> dict:
            rows = at.table("profiles")
            if rows.filter(F.col("id") == profile_id).isEmpty():
                raise TidelogError("PROFILE_NOT_FOUND", "There is no such profile", str(profile_id))
            return {"profiles": rows.filter(F.col("id") != profile_id)}

        self.update(drop)


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """``filename, bytes, sha256`` of files, by name, computed on the workers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("filename")


def tree_hashes(spark: SparkSession, folder: str) -> list[dict]:
    """``filename`` (below the folder), ``bytes, sha256`` of all files under a folder, by name; a manifest lists them."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", re.escape(root) + "/", 2), -1)
    rows = files.select(name.alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return sorted((r.asDict() for r in rows.collect()), key=lambda x: x["filename"])


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
