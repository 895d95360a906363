"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are grouped by length into buckets, buckets into cells of bounded size.  A bounded sample of
vectors gives each query a score that its k-th best is known to reach.  A query visits the cells of
those buckets only whose longest vector could reach that score.  Inside a cell the score asked for,
divided by both lengths, is the cosine that a candidate needs.  Where that cosine is high, candidates are
looked up by coordinate: a vector within the angle of the query has each coordinate's angle within
it too, so sorted angles of the query's largest coordinates give a short list.  Where it is low,
the cell is scanned from its longest vector down to the length that still reaches the score.  Either
way the products of what remains are computed in whole numbers, and nothing that could be in
the result is left out.

Queries and cells meet in a grid of tasks: a cell's vectors are in memory (bounded), queries stream past.

Defined cases: ``vectors`` has those of vectors.  A query is a distinct pair of id and vector; rows that
have its id are its own and no candidates.  Repeated candidate rows count each.  Ties go to the smaller id.
With fewer than k candidates all are returned; an empty table gives no rows.  Scores stay within a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import kernels, vectors

#: Components of one cell, which a task holds in memory as doubles.
CELL_VALUES = 1 << 22
#: Queries of one column of the grid.
PART_ROWS = 1 << 17
#: Buckets of length, at most.
BUCKETS = 256
#: Rows of the sample that gives the first thresholds.
SEEDS = 2048
#: Rows of a cell that are multiplied at once, and queries at once.
RUN, QUERIES = 8192, 64
#: Coordinates looked at; the least cosine at which coordinates are tried; a list is used if it is so much shorter than the scan.
FOCUS, COSINE, SHORTER = 4, 0.5, 8
_GRID = "cell int, part int, kind int, id long, dim int, vec binary, norm double, floor long, qkey long"


class Cell:
    """Vectors of one cell, longest first, with sorted angles of those coordinates that queries ask for."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, norms: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.vecs, self.norms = ids[order], vecs[order], norms[order]
        self.angles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_angles(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.angles:
            with np.errstate(divide="ignore", invalid="ignore"):
                angle = np.arccos(np.clip(np.nan_to_num(self.vecs[:, f] / self.norms), -1, 1))
            order = np.argsort(angle, kind="stable")
            self.angles[f] = (angle[order], order)
        return self.angles[f]

    def listed(self, query: np.ndarray, norm: float, floor: np.ndarray, prefix: int) -> np.ndarray | None:
        """Candidates by coordinate for a score of ``floor`` or more, or None where the scan of ``prefix`` rows is as good."""
        cosine = float(vectors.least_useful(floor)) / (norm * self.norms[0]) if norm and self.norms[0] else 0.0
        if not COSINE <= cosine or not self.vecs.shape[1]:
            return None
        within = math.acos(min(1.0, cosine)) + 1e-6
        spans = []
        wide = min(len(query), self.vecs.shape[1])
        for f in np.argsort(-np.abs(query[:wide]), kind="stable")[:FOCUS].tolist():
            angles, order = self.sorted_angles(f)
            at = math.acos(max(-1.0, min(1.0, query[f] / norm)))
            lo, hi = np.searchsorted(angles, (at - within, at + within), "left")
            spans.append((int(hi - lo), order[lo:hi], f))
        n, rows, first = min(spans, key=lambda x: x[0])
        if n * SHORTER > prefix:
            return None
        # what the looked-at coordinates and the length of the rest allow
        focus = [f for _, _, f in spans]
        near = self.vecs[rows][:, focus]
        rest = math.sqrt(max(0.0, norm**2 - float(query[focus] @ query[focus]))) * np.sqrt(np.maximum(0.0, self.norms[rows] ** 2 - (near * near).sum(1)))
        reach = near @ query[focus] + rest
        return np.sort(rows[reach + 1e-6 * norm * self.norms[rows] >= float(vectors.least_useful(floor))])

    def best(self, qids: np.ndarray, queries: np.ndarray, norms: np.ndarray, floors: np.ndarray, k: int) -> vectors.Best:
        found = vectors.Best(len(qids), k, floors)
        listed = np.zeros(len(qids), dtype=bool)
        for start in range(0, len(self.ids), RUN):
            # the longest vector from here on bounds every later score
            live = np.flatnonzero(~listed & (norms * self.norms[start] >= vectors.least_useful(found.floor)))
            if not len(live):
                break
            if start in (0, RUN):  # at the beginning, and once a first run has raised the thresholds
                for q in live.tolist():
                    with np.errstate(divide="ignore"):
                        prefix = int(np.searchsorted(-self.norms, -float(vectors.least_useful(found.floor[q])) / norms[q] if norms[q] else 0.0, "right"))
                    rows = self.listed(queries[q], norms[q], found.floor[q], prefix)
                    if rows is not None:
                        listed[q] = True
                        rows = rows[(rows >= start) & (self.ids[rows] != qids[q])]
                        found.offer_all(np.array([q]), vectors.products(queries[q : q + 1], self.vecs[rows]), self.ids[rows])
                live = live[~listed[live]]
            if len(live):
                part = slice(start, start + RUN)
                found.offer_all(live, vectors.products(queries[live], self.vecs[part]), self.ids[part], qids[live][:, None] == self.ids[part][None, :])
        return found


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _meet(k: int) -> vectors.Kernel:
    """Cells and queries of the grid, sorted by cell, part and kind -> the best of the cell for each query."""

    def run(batches: vectors.Batches) -> vectors.Batches:
        key, held, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, parts, kinds = _columns(batch, "cell", "part", "kind")
            edges = np.flatnonzero(np.diff(cells) | np.diff(parts) | np.diff(kinds)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if (int(cells[a]), int(parts[a])) != key:
                    key, held, cell = (int(cells[a]), int(parts[a])), [], None
                if kinds[a] == 0:
                    held.append(piece)
                    continue
                if not held and cell is None:
                    continue
                if cell is None:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    ids, dims, norms = _columns(whole, "id", "dim", "norm")
                    cell, held = Cell(ids, vectors.matrix(dims, whole.column("vec")), norms), []
                for s in range(0, piece.num_rows, QUERIES):
                    some = piece.slice(s, QUERIES)
                    qids, dims, norms, floors, qkeys = _columns(some, "id", "dim", "norm", "floor", "qkey")
                    row, ids, scores = cell.best(qids, vectors.matrix(dims, some.column("vec")), norms, floors, k).rows()
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(qkeys[row]), pa.array(ids), pa.array(scores)], names=["query_id", "qkey", "vec_id", "score"])

    return run


def search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, scale: int = 1024, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest scores of every row for which ``is_query`` (over a column ``id``) holds."""
    spark = kernels.session(df)
    rows = kernels.cut(vectors.packed(df.select(id_col, vec_col), id_col, vec_col, scale).drop("label"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dim").alias("values"), F.max("dim").alias("widest")).first()
    out = "query_id long, qkey long, vec_id long, score long"
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # buckets of length, from the longest; a bucket that many rows share (one length) has several cells
    per_cell = max(256, CELL_VALUES // max(1, size["values"] // size.n))
    want = max(math.ceil(size.n / per_cell), min(2 * spark.sparkContext.defaultParallelism, math.ceil(size.n / 512)))
    n_buckets = min(BUCKETS, want)
    cuts = sorted(set(rows.approxQuantile("norm", [i / n_buckets for i in range(1, n_buckets)], 0.25 / n_buckets)), reverse=True) if n_buckets > 1 else []
    edges = -np.array(cuts)  # ascending
    bucket = F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c > norm))") if cuts else F.lit(0)
    per = {r.b: r for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}  # a row for each bucket
    n_cells = {b: max(math.ceil(r.n / per_cell), math.ceil(r.n * want / size.n / 1.5)) for b, r in per.items()}
    first_cell = dict(zip(sorted(per), np.concatenate(([0], np.cumsum([n_cells[b] for b in sorted(per)]))).tolist(), strict=False))
    cells = sum(n_cells.values())
    longest = np.repeat([per[b].longest for b in sorted(per)], [n_cells[b] for b in sorted(per)])

    # a bounded sample: the longest vectors and others by hash
    n_seeds = max(16, min(SEEDS, (1 << 21) // max(1, size.widest)))
    sample = rows.orderBy(F.desc("norm"), "id").limit(n_seeds // 2).unionByName(rows.orderBy(F.xxhash64("id", "vec"), "id").limit(n_seeds // 2)).dropDuplicates(["id", "vec"])
    seed_ids, seed_vecs = vectors.batches_of([r.asDict() for r in sample.collect()])
    seeds = spark.sparkContext.broadcast((seed_ids, seed_vecs))
    queries = rows.filter(is_query).select("id", "dim", "vec", "norm", F.xxhash64("vec").alias("qkey")).dropDuplicates(["id", "qkey", "vec"])
    n_parts = max(1, math.ceil(rows.filter(is_query).count() / PART_ROWS))

    def ask(batches: vectors.Batches) -> vectors.Batches:
        """Queries for every cell whose longest vector can reach their first threshold."""
        ids, vecs = seeds.value
        n = 0
        for batch in batches:
            for s in range(0, batch.num_rows, QUERIES):
                some = batch.slice(s, QUERIES)
                qids, dims, norms = _columns(some, "id", "dim", "norm")
                found = vectors.Best(len(qids), k)
                found.offer_all(np.arange(len(qids)), vectors.products(vectors.matrix(dims, some.column("vec")), vecs), ids, qids[:, None] == ids[None, :])
                q, c = np.nonzero(norms[:, None] * longest[None, :] >= vectors.least_useful(found.floor)[:, None])
                take = pa.array(q)
                part = (n + q) % n_parts
                n += len(qids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(q), np.int32)), *(some.column(x).take(take) for x in ("id", "dim", "vec", "norm")), pa.array(found.floor[q]), some.column("qkey").take(take)],
                    names=[x.split()[0] for x in _GRID.split(", ")],
                )

    def deal(batches: vectors.Batches) -> vectors.Batches:
        """Every vector in a cell of its bucket, once for each part of the queries.  Cells of a bucket take turns, so that one id or vector cannot fill one."""
        turn = 0
        for batch in batches:
            b = np.searchsorted(edges, -batch.column("norm").to_numpy(zero_copy_only=False), "left") if len(edges) else np.zeros(batch.num_rows, np.int64)
            cell = np.array([first_cell[x] for x in b.tolist()], dtype=np.int64) + (turn + np.arange(batch.num_rows)) % np.array([n_cells[x] for x in b.tolist()], dtype=np.int64)
            turn += batch.num_rows
            none = pa.nulls(batch.num_rows, pa.int64())
            for part in range(n_parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.zeros(batch.num_rows, np.int32)), *(batch.column(x) for x in ("id", "dim", "vec", "norm")), none, none],
                    names=[x.split()[0] for x in _GRID.split(", ")],
                )

    grid = rows.select("id", "dim", "vec", "norm").mapInArrow(deal, _GRID).unionByName(queries.mapInArrow(ask, _GRID))
    met = grid.repartition(cells * n_parts, "cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(_meet(k), out)
    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
