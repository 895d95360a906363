"""Evidence: sources, paragraph chunks, vectors, exact top-k retrieval, citations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.errors import TidelogError
from tidelog.operators import tables
from tidelog.schema import METRICS, MOMENTS
from tidelog.sources.workspace import Files
from tidelog.workers import reach

CHUNK_BYTES = 1600
SNIPPET_BYTES = 280
#: Texts above this size are packed by ``packed_by_jumps``.
LONG_BYTES = 1 << 20
TOP_K_MAX = 50
CONTEXT_MAX = 50
EMBED_BYTES = 12_000


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def snippet(c: Column, most: int = SNIPPET_BYTES) -> Column:
    """The trimmed text, cut to whole characters within ``most`` bytes and marked where it was longer."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    # of the first `most` characters, as many as fit; each has four bytes at most
    head = F.substring(t, 1, most)
    fit = F.aggregate(F.split(head, ""), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda s, x: F.struct((s["bytes"] + F.octet_length(x)).alias("bytes"), F.when(s["bytes"] + F.octet_length(x) <= most, s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])
    cut = F.when(F.octet_length(head) == F.length(head), head).otherwise(F.substring(head, F.lit(1), fit))
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(line_ends(text), "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def packed(text: Column, most: int = CHUNK_BYTES) -> Column:
    """Paragraphs packed in order while they fit; a paragraph over the limit is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(s: Column, p: Column) -> Column:
        fits = F.octet_length(s["buf"]) + 2 + F.octet_length(p) <= most
        flush = F.struct(F.concat(s["done"], F.array(s["buf"])).alias("done"), p.alias("buf"))
        more = F.struct(s["done"].alias("done"), F.concat(s["buf"], F.lit("\n\n"), p).alias("buf"))
        first = F.struct(s["done"].alias("done"), p.alias("buf"))
        return F.when(s["buf"] == "", first).when(fits, more).otherwise(flush)

    return F.aggregate(paragraphs(text), empty, add, lambda s: F.when(s["buf"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["buf"]))))


def packed_by_jumps(sources: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """As ``packed``, for texts of any number of paragraphs: ``source_id, ordinal, text``.

    Running sums of bytes tell for every paragraph where the next chunk would begin if one began with it.  Following these pointers from the
    first paragraph marks the chunks' beginnings; pointers are doubled each round, so a text of a million chunks takes twenty rounds.
    """
    rows = sources.select("source_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "p"))
    by = Window.partitionBy("source_id").orderBy("pos")
    # where a paragraph begins, with the two bytes between paragraphs; one row more ends the text
    begin = F.coalesce(F.sum(F.octet_length("p")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 2 * F.col("pos")
    rows = durable.written(rows.withColumn("u", begin.cast("long")))
    end = rows.groupBy("source_id").agg((F.max("pos") + 1).alias("pos"), F.max(F.col("u") + F.octet_length("p") + 2).alias("u"))
    reach = Window.partitionBy("source_id").orderBy("u").rangeBetween(Window.unboundedPreceding, most + 2)
    following = F.greatest(F.count(F.lit(1)).over(reach) - 1, F.col("pos") + 1).cast("int")
    jump = durable.written(rows.select("source_id", "pos", "u").unionByName(end).withColumn("to", following).join(end.select("source_id", F.col("pos").alias("n")), "source_id").filter("to < n").select("source_id", "pos", "to"))
    marks = durable.written(rows.filter("pos = 0").select("source_id", "pos"))
    while True:
        more = durable.written(marks.join(jump, ["source_id", "pos"]).select("source_id", F.col("to").alias("pos")))
        if more.isEmpty():
            break
        marks = marks.unionByName(more)
        further = jump.select("source_id", F.col("pos").alias("to"), F.col("to").alias("then"))
        jump = durable.written(jump.join(further, ["source_id", "to"]).select("source_id", "pos", F.col("then").alias("to")))
    counted = rows.join(marks.withColumn("first", F.lit(1)), ["source_id", "pos"], "left").withColumn("ordinal", (F.sum(F.coalesce("first", F.lit(0))).over(by) - 1).cast("int"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"])  # of one chunk
    return counted.groupBy("source_id", "ordinal").agg(F.array_join(pieces, "\n\n").alias("text"))


#: The kinds of sources, of origins and of chunks.
SOURCE_TYPES = ("sanitized_export", "slack_transcript", "incident_report_md", "freeform_text")
ORIGINS = ("file", "directory", "paste")
PARAGRAPH, BUNDLE = "paragraph", "sanitized_incident_bundle"

_KEEP = {"ignoreNullFields": "false"}


def meta(kind: Column, incident_keys: Column | None = None, time_range: Column | None = None) -> Column:
    """A chunk's metadata."""
    keys = F.lit(None) if incident_keys is None else incident_keys
    span = F.lit(None) if time_range is None else time_range
    return F.struct(keys.cast("array<string>").alias("incident_keys"), kind.alias("kind"), span.cast("struct<end_ts:string,start_ts:string>").alias("time_range"))


def chunk_rows(drafts: DataFrame) -> DataFrame:
    """drafts (source_id, ordinal, text, meta) -> ``chunk_id, source_id, ordinal, text, text_sha256, token_count_est, meta``.

    The id is a hash of the place, the text and the metadata as JSON with sorted keys and nulls written.
    """
    out = drafts.withColumn("text", line_ends(F.col("text")))
    out = out.withColumns({"text_sha256": F.sha2("text", 256), "token_count_est": F.octet_length("text")})
    key = F.concat_ws("|", F.lit("v1"), "source_id", F.col("ordinal").cast("string"), "text_sha256", F.sha2(F.to_json("meta", _KEEP), 256))
    return out.withColumn("chunk_id", F.sha2(key, 256)).select("chunk_id", "source_id", "ordinal", "text", "text_sha256", "token_count_est", "meta")


def chunks(sources: DataFrame, most: int = CHUNK_BYTES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """sources (source_id, text) -> the chunks of their paragraphs.  Texts of more than ``long_bytes`` are packed paragraph by paragraph over the
    cluster, others each in its row; the chunks are the same."""
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    drafts = sources.filter(~is_long).select("source_id", F.posexplode(packed(F.col("text"), most)).alias("ordinal", "text"))
    large = sources.filter(is_long)
    if not large.isEmpty():
        drafts = drafts.unionByName(packed_by_jumps(large, most))
    return chunk_rows(drafts.withColumn("meta", meta(F.lit(PARAGRAPH))))


def bundle_text() -> Column:
    """One incident of an export, with its ``codes`` (sorted, once each) and ``events`` (in their order), as text for retrieval."""
    line = lambda name, c: F.concat(F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
    if_known = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name), F.col(c).cast("string")))
    event = lambda e: F.concat(F.lit("  - ts="), F.coalesce(e["ts"], F.lit("NULL")), F.lit("; source="), e["source"], F.lit("; kind="), F.coalesce(e["kind"], F.lit("NULL")), F.lit("; text_redacted="), e["text_redacted"].cast("string"))
    some = lambda head, c, show: F.when(F.size(c) > 0, F.concat(F.array(F.lit(head)), F.transform(c, show))).otherwise(F.array().cast("array<string>"))
    # fixed values: the names of the lines
    head = [F.concat(F.lit("Incident Key: "), "incident_key"), if_known("Severity: ", "severity"), if_known("Detection Source: ", "detection_source"), if_known("Vendor: ", "vendor"), if_known("Service: ", "service"), if_known("Impact %: ", "impact_pct"), if_known("Service Health %: ", "service_health_pct")]
    times_ = [F.lit("Timestamps (RFC3339, nullable):"), *(line(f"  {m}: ", m) for m in MOMENTS)]
    measures = [F.lit("Deterministic metrics (seconds, nullable):"), *(line(f"  {m}: ", f"metrics.{m}") for m in METRICS), line("Warning count: ", "warning_count")]
    fixed = F.array_compact(F.array(*head, *times_, *measures))
    return F.array_join(F.concat(fixed, some("Warnings (codes):", "codes", lambda c: F.concat(F.lit("  - "), c)), some("Timeline events (sanitized):", "events", event)), "\n")


def bundle_chunks(source_id: str, incidents: DataFrame, events: DataFrame, warnings: DataFrame) -> DataFrame:
    """The chunks of an export without free text: one for each incident, in order of key.  The tables are those of ``sanitizing.read``,
    whose events may bring ``pos``, their place in the file; else they are ordered as the export writes them."""
    events = events.join(incidents.select("incident_key"), "incident_key", "left_semi")  # those of unknown incidents may be many
    order = ["pos"] if "pos" in events.columns else [F.col("ts").isNotNull().alias("known"), "ts", "source"]
    per_event = events.groupBy("incident_key").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct("ts", "source", "kind", "text_redacted").alias("e")))).alias("x"))
    per_event = per_event.select("incident_key", F.transform("x", lambda x: x["e"]).alias("events"))
    codes = warnings.groupBy("incident_key").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    whole = incidents.join(per_event, "incident_key", "left").join(codes, "incident_key", "left")
    whole = tables.ranked(whole, [F.col("incident_key")])
    span = F.struct(F.col("resolve_ts").alias("end_ts"), F.col("start_ts").alias("start_ts"))
    return chunk_rows(whole.select(F.lit(source_id).alias("source_id"), (F.col("rn") - 1).cast("int").alias("ordinal"), bundle_text().alias("text"), meta(F.lit(BUNDLE), F.array("incident_key"), span).alias("meta")))


def source_id(source_type: Column, origin_kind: Column, path: Column) -> Column:
    """A hash of what a source is, not of its label or time: JSON with sorted keys, nulls written."""
    origin = F.struct(origin_kind.alias("kind"), path.alias("path"))
    return F.sha2(F.to_json(F.struct(origin.alias("origin"), source_type.alias("type")), _KEEP), 256)


def register(sources: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new sources: a source with a known id replaces the old one; in order of id."""
    both = sources.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("source_id").orderBy(F.desc("__new"), F.desc("created_at"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new").orderBy("source_id")


def check_source(source_type: str, origin_kind: str, label: str, path: str | None, text: str | None) -> None:
    """Raises for a source that cannot be registered."""
    checks = (
        (source_type in SOURCE_TYPES, "Unknown type of source"), (bool(label.strip()), "A source needs a label"), (origin_kind in ORIGINS, "A source comes from a file, a directory or a paste"),
        (origin_kind == "paste" or path is not None, "A file or directory needs a path"), (origin_kind != "paste" or bool((text or "").strip()), "A paste needs a text"),
    )
    for fine, message in checks:
        if not fine:
            raise TidelogError("AI_EVIDENCE_SOURCE_INVALID", message, f"kind={origin_kind}")


def new_source(spark: SparkSession, source_type: str, origin_kind: str, label: str, created_at: str, path: str | None = None, text: str | None = None) -> DataFrame:
    """A checked row for ``register``: ``source_id, type, origin_kind, path, label, created_at, text`` (of a paste, with plain line ends)."""
    check_source(source_type, origin_kind, label, path, text)
    row = spark.createDataFrame([(source_type, origin_kind, path, label, created_at, text if origin_kind == "paste" else None)], "type string, origin_kind string, path string, label string, created_at string, text string")
    return row.select(source_id(F.col("type"), F.col("origin_kind"), F.col("path")).alias("source_id"), "type", "origin_kind", "path", "label", "created_at", line_ends(F.col("text")).alias("text"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names it when it reads it: with the scheme and host of its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def source_texts(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """``source_id, text`` of the registered sources that hold text: pastes as stored, files read whole by Spark."""
    pasted = sources.filter("origin_kind = 'paste'").select("source_id", "text")
    in_files = sources.filter("origin_kind = 'file' and type <> 'sanitized_export'").select("source_id", "path")
    named = [(r["source_id"], qualified(spark, r["path"])) for r in in_files.collect()]  # registered by hand
    if not named:
        return pasted
    read = spark.read.format("binaryFile").load(sorted({p for _, p in named})).select(F.col("path").alias("__path"), F.decode("content", "utf-8").alias("text"))
    files = durable.written(spark.createDataFrame(named, "source_id string, __path string").join(read, "__path", "left").select("source_id", "text"))
    lost = [r["source_id"] for r in files.filter("text is null").select("source_id").limit(5).collect()]
    if lost:
        raise TidelogError("AI_EVIDENCE_SOURCE_INVALID", "A registered file gives no text", ", ".join(lost))
    return pasted.unionByName(files)


def rebuild(spark: SparkSession, sources: DataFrame, stored: DataFrame | None, read_export: Callable[[str], tuple[DataFrame, DataFrame, DataFrame]], only: str | None = None) -> DataFrame:
    """The chunk table after its sources (or one of them) are chunked anew; chunks of other sources stay.

    sources is the registry; ``read_export`` gives the three tables of an export's folder.
    """
    chosen = sources if only is None else sources.filter(F.col("source_id") == only)
    if chosen.isEmpty():
        raise TidelogError("AI_EVIDENCE_EMPTY" if only is None else "AI_EVIDENCE_SOURCE_INVALID", "There is no such source", only)
    out = chunks(source_texts(spark, chosen))
    for r in chosen.filter("type = 'sanitized_export'").select("source_id", "path").collect():  # registered by hand
        out = out.unionByName(bundle_chunks(r["source_id"], *read_export(r["path"])))
    return out if stored is None else stored.join(chosen.select("source_id"), "source_id", "left_anti").select(*out.columns).unionByName(out)


def listing(chunk_table: DataFrame, source: str | None = None) -> DataFrame:
    rows = chunk_table if source is None else chunk_table.filter(F.col("source_id") == source)
    return rows.select("chunk_id", "source_id", "ordinal", "text_sha256", "token_count_est", snippet(F.col("text")).alias("snippet")).orderBy("source_id", "ordinal", "chunk_id")


def chunk(chunk_table: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk with its snippet; an unknown id is an error."""
    found = chunk_table.filter(F.col("chunk_id") == chunk_id).withColumn("snippet", snippet(F.col("text")))
    if found.isEmpty():
        raise TidelogError("AI_EVIDENCE_NOT_FOUND", "There is no such chunk", f"id={chunk_id}")
    return found


def context(chunk_table: DataFrame, centers: DataFrame, window: int) -> DataFrame:
    """``center_id, chunk_id, distance``: chunks of the same source up to window places away, for each center."""
    if not 0 <= window <= CONTEXT_MAX:
        raise TidelogError("AI_EVIDENCE_CONTEXT_INVALID", "Context window is out of range", f"window={window}")
    ranked = chunk_table.select("source_id", "chunk_id", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "chunk_id")).alias("rn"))
    mid = ranked.join(centers.select("chunk_id").distinct(), "chunk_id", "left_semi").select("source_id", F.col("chunk_id").alias("center_id"), F.explode(F.sequence(F.col("rn") - window, F.col("rn") + window)).alias("rn"), F.col("rn").alias("mid"))
    return mid.join(ranked, ["source_id", "rn"]).select("center_id", "chunk_id", (F.col("rn") - F.col("mid")).alias("distance"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("float"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v)).cast("float")


def search(vectors: DataFrame, query: list[float], k: int, sources: DataFrame | None = None) -> DataFrame:
    """Exact top-k by cosine: ``chunk_id, score``; vectors without length are skipped; ties by id."""
    k = max(1, min(k, TOP_K_MAX))
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    rows = vectors if sources is None else vectors.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    scored = rows.withColumns({"n": norm(F.col("embedding")), "d": _dot(F.col("embedding"), q)}).filter("n <> 0")
    size = float(sum(x * x for x in query)) ** 0.5
    if size == 0:
        return scored.select("chunk_id", F.lit(0.0).cast("float").alias("score")).limit(0)
    score = (F.col("d") / (F.col("n") * F.lit(size).cast("float"))).cast("float")
    return scored.select("chunk_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


#: Queries that are scored at one time, and the components they may have together; a task multiplies so many vectors by them at once.
QUERY_BLOCK, QUERY_VALUES, VECTOR_RUN = 1024, 1 << 21, 2048


def search_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k by cosine of many queries (``query_id, embedding``): ``query_id, rank, chunk_id, score``, rank from 1.

    Queries go round in blocks of bounded size.  Tasks multiply their vectors by a block, run by run, and hold the k best of each query; what
    all tasks held is merged once.  Vectors without length, null ones and those of another length than the query's are no candidates, and a
    query without length has no hits.  Scores are doubles.
    """
    k, spark = max(1, min(k, TOP_K_MAX)), reach(vectors.sparkSession)
    widest = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    per_block = max(1, min(QUERY_BLOCK, QUERY_VALUES // widest))
    placed = durable.written(tables.ranked(queries.filter("query_id is not null and embedding is not null").select(F.col("query_id").cast("string").alias("query_id"), "embedding"), [F.col("query_id")]))
    found = None
    for start in range(0, placed.count(), per_block):
        rows = placed.filter(F.col("rn").between(start + 1, start + per_block)).orderBy("rn").collect()  # one block
        block = spark.sparkContext.broadcast([(r["query_id"], r["embedding"]) for r in rows])
        hits = vectors.filter("embedding is not null").select("chunk_id", "embedding").mapInArrow(_scored(block, k), "query_id string, chunk_id string, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id string, rank int, chunk_id string, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "chunk_id", "score")


def _scored(block: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best vectors of a partition for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[int]] = {}
        for n, (_, v) in enumerate(block.value):
            by_size.setdefault(len(v), []).append(n)
        units = {}
        for size, at in by_size.items():
            m = np.array([block.value[n][1] for n in at], dtype=np.float64).reshape(len(at), size)
            length = np.sqrt((m * m).sum(1))
            units[size] = ([n for n, x in zip(at, length, strict=True) if x], m[length > 0] / length[length > 0, None])
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, VECTOR_RUN):
                ids, vecs = batch.column(0)[start : start + VECTOR_RUN].to_numpy(zero_copy_only=False), batch.column(1)[start : start + VECTOR_RUN]
                sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
                for size in np.intersect1d(sizes, list(units)).tolist():
                    at, unit = units[size]
                    mine = np.flatnonzero(sizes == size)
                    m = pc.list_flatten(vecs.take(pa.array(mine))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(mine), size)
                    length = np.sqrt((m * m).sum(1))
                    some = np.isfinite(length) & (length > 0)
                    scores = (unit @ (m[some] / length[some, None]).T)
                    names = ids[mine[some]]
                    for q, row in zip(at, scores, strict=True):
                        held = best.get(q)
                        s, i = (row, names) if held is None else (np.concatenate((held[0], row)), np.concatenate((held[1], names)))
                        if len(s) > k:  # ties at the cut stay until they are put in order
                            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                            s, i = s[keep], i[keep]
                        order = np.lexsort((i.astype(str), -s))[:k]
                        best[q] = (s[order], i[order])
        for q, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([block.value[q][0]] * len(s), pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "score"])

    return run


def dims(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count_distinct(F.size("embedding")).alias("n_dims"), F.min(F.size("embedding")).alias("dims"), F.count(F.lit(1)).alias("n"))


def stale(chunk_table: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose text the index does not have yet."""
    return chunk_table.join(index.select("chunk_id", "text_sha256"), ["chunk_id", "text_sha256"], "left_anti")


@dataclass(frozen=True)
class IndexStatus:
    """What an index was built from; it serves queries once it is ready."""

    ready: bool = False
    model: str | None = None
    dims: int | None = None
    chunk_count: int = 0
    chunks_total: int = 0
    source_id: str | None = None
    updated_at: str | None = None


Embedder = Callable[[list[str]], list[list[float]]]


def build_index(chunk_table: DataFrame, index: DataFrame, embed: Embedder) -> DataFrame:
    """The index of exactly these chunks: vectors of unchanged ones are kept, others embedded in batches."""
    keep = index.join(chunk_table.select("chunk_id", "text_sha256"), ["chunk_id", "text_sha256"], "left_semi").select("chunk_id", "text_sha256", "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode()[:EMBED_BYTES].decode("utf-8", "ignore") for t in b["text"]]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "text_sha256": b["text_sha256"], "embedding": embed(texts) if texts else []})

    new = stale(chunk_table, index).select("chunk_id", "text_sha256", "text").mapInPandas(run, "chunk_id string, text_sha256 string, embedding array<float>")
    return keep.unionByName(new)


def refresh_index(chunk_table: DataFrame, index: DataFrame, status: IndexStatus, embed: Embedder, model: str, updated_at: str, source: str | None = None) -> tuple[DataFrame, IndexStatus]:
    """The index of a source's chunks (or of all) and its status.  Vectors are kept only from a ready index of the same model and scope;
    vectors of unlike lengths are an error."""
    wanted = chunk_table if source is None else chunk_table.filter(F.col("source_id") == source)
    total = wanted.count()
    if total == 0:
        raise TidelogError("AI_INDEX_NOT_READY", "There are no chunks to index; build chunks first")
    same = status.ready and status.model == model and status.source_id == source
    built = durable.written(build_index(wanted, index if same else index.limit(0), embed))
    found = dims(built).first()
    if found["n_dims"] != 1 or (same and status.dims is not None and found["dims"] != status.dims):
        raise TidelogError("AI_INDEX_BUILD_FAILED", "Vectors differ in length", f"expected={status.dims if same else found['dims']}")
    return built, IndexStatus(True, model, found["dims"], found["n"], total, source, updated_at)


def write_status(files: Files, status: IndexStatus) -> None:
    files.put(json.dumps(asdict(status), indent=2), "index_status.json")


def read_status(files: Files) -> IndexStatus:
    """The stored status; that of an index not built yet if there is none."""
    return IndexStatus(**json.loads(files.read("index_status.json"))) if files.exists("index_status.json") else IndexStatus()


def retrieve(chunk_table: DataFrame, index: DataFrame, status: IndexStatus, embed: Embedder, question: str, k: int, sources: list[str] | None = None) -> DataFrame:
    """The best chunks for a question: ``chunk_id, source_id, score, snippet, locator``, best first."""
    if not question.strip():
        raise TidelogError("AI_RETRIEVAL_FAILED", "The question is empty")
    if not status.ready or status.model is None or status.dims is None:
        raise TidelogError("AI_INDEX_NOT_READY", "The index is not built yet")
    query = embed([question.strip()])[0]
    if len(query) != status.dims or not any(query):
        raise TidelogError("AI_RETRIEVAL_FAILED", "The question's vector does not suit the index", f"index_dims={status.dims}; query_dims={len(query)}")
    if not index.filter(F.size("embedding") != status.dims).isEmpty():
        raise TidelogError("AI_RETRIEVAL_FAILED", "A vector of the index has another length", f"expected={status.dims}")
    rows = index.join(chunk_table.select("chunk_id", "source_id"), "chunk_id")
    spark = chunk_table.sparkSession
    hits = search(rows, query, k, None if sources is None else spark.createDataFrame([(x,) for x in sources], "source_id string"))
    # TOP_K_MAX hits at most
    shown = chunk_table.join(F.broadcast(hits), "chunk_id").select("chunk_id", "source_id", "score", snippet(F.col("text")).alias("snippet"))
    return shown.join(locator(chunk_table), "chunk_id").orderBy(F.desc("score"), "chunk_id")


def chunk_page(chunk_table: DataFrame, limit: int = tables.PAGE, offset: int = 0, source: str | None = None) -> tuple[DataFrame, dict]:
    """A page of ``listing`` and its envelope."""
    if not 1 <= limit <= tables.PAGE_MAX or offset < 0:
        raise TidelogError("INVALID_PAGINATION", "Pagination is out of range", f"limit={limit}; offset={offset}")
    rows = listing(chunk_table, source)
    total = rows.count()
    return rows.offset(offset).limit(limit), {"total": total, "limit": limit, "offset": offset, "has_next": offset + limit < total, "has_prev": offset > 0}


def wrong_citations(citations: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """citations (chunk_id, locator) that do not hold: ``chunk_id, code``, for an unknown chunk or a locator that is not the stored one."""
    stored = locator(chunk_table).select("chunk_id", F.col("locator").alias("stored"))
    both = citations.join(stored, "chunk_id", "left")
    code = F.when(F.col("stored").isNull(), "AI_EVIDENCE_NOT_FOUND").when(~F.col("stored").eqNullSafe(F.col("locator")), "AI_CITATION_INVALID")
    return both.select("chunk_id", code.alias("code")).filter("code is not null")


def check_citations(citations: DataFrame, chunk_table: DataFrame) -> None:
    if citations.isEmpty():
        raise TidelogError("AI_CITATION_REQUIRED", "At least one citation is needed")
    for r in wrong_citations(citations, chunk_table).orderBy("chunk_id").limit(1).collect():
        raise TidelogError(r["code"], "A citation does not match a stored chunk", f"chunk_id={r['chunk_id']}")


CITE = r"\[\[chunk:([^\]]*)\]\]"


def cited(text: Column) -> Column:
    ids = F.transform(F.regexp_extract_all(text, F.lit(CITE), 1), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x != "")))


def uncited(text: Column, by: str) -> Column:
    """1-based positions of bullets (``by='bullet'``) or paragraphs without a citation."""
    if by == "bullet":
        parts = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* "))
    else:
        parts = F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != "")
    return F.array_compact(F.transform(parts, lambda x, i: F.when(~x.contains("[[chunk:"), i + 1)))


def locator(chunk_table: DataFrame) -> DataFrame:
    none = F.lit(None).cast("struct<start:int,end:int>")
    return chunk_table.select("chunk_id", F.struct("source_id", "ordinal", "text_sha256", none.alias("char_range")).alias("locator"))


def evidence_blocks(chunk_table: DataFrame, ids: DataFrame) -> DataFrame:
    """One text of the chosen chunks (chunk_id, pos), in their order."""
    head = F.concat(F.lit("[[chunk:"), "chunk_id", F.lit("]] source_id="), "source_id", F.lit(" ordinal="), F.col("ordinal").cast("string"), F.lit(" text_sha256="), "text_sha256", F.lit("\n"), "text")
    rows = ids.join(chunk_table, "chunk_id").select("pos", head.alias("block"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("blocks"))
