"""Hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

Inner products become distances by one more component: candidates get sqrt(M^2 - |x|^2), so that all
have the length M of the longest row, anchors get 0; then |a - s|^2 = |a|^2 + M^2 - 2 a.s, and the
highest products are the nearest rows.  Pivots, a bounded sample, divide the space: each anchor
belongs to its nearest pivot's group.  A bounded sample of rows gives each anchor a score that its
k-th best reaches, thus a radius.  A group's reach is the largest pivot distance plus radius of its
anchors, so a candidate goes to a group only if its distance to the pivot is within the reach, and if
the plane half way between its own pivot and the group's is not farther off than the largest radius.  Then
each group is joined exactly, in whole numbers: a block of its anchors in memory (bounded), candidates
streaming past in slices.

Two joins follow each other: positives (the nearest of an anchor's label; groups are by pivot and class
of labels), then negatives, whose score must lie in a window of the positive's.  The window also has an
upper end, so a candidate nearer to a whole group than every window allows isn't sent there either.

Defined cases: those of ``vectors``; rows with a null label take no part.  An anchor is a distinct id, label and
vector; rows with its id are its own.  Repeated rows count each, so a positive that is there twice makes two
lists.  A positive with a negative score has an empty window, one with score 0 the window 0 to 0.
Anchors without positives, or without negatives, give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import kernels, vectors

#: Rows of the sample of thresholds and pivots; pivots at least and at most; anchors for each pivot, about.
SEEDS, LEAST_PIVOTS, PIVOTS, PER_PIVOT = 2048, 8, 256, 256
#: Classes of labels; groups of the first join are by class and pivot.
CLASSES = 64
#: Anchors in a task's memory, candidates of one slice, candidates and anchors multiplied at once.
BLOCK, SLICE, RUN, STEP = 1024, 1 << 18, 2048, 128
#: Rounding of distances in units of the greatest length, and of distances to planes.
EPS, PLANE_EPS = 1e-9, 1e-5
_GRID = "task int, kind int, id long, label long, dim int, vec binary, akey long, n int, ids array<long>, scores array<long>, lows array<long>"


def share(pct: int, score: np.ndarray, up: bool) -> np.ndarray:
    """pct % of whole scores, rounded up or down, without leaving the longs."""
    whole, rest = score // 100, score % 100
    return pct * whole + (-((-pct * rest) // 100) if up else (pct * rest) // 100)


class Space:
    """Pivots on the sphere of the longest row, in units of its length."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.unit = longest or 1.0
        self.pivots = pivots / self.unit
        self.extra = np.sqrt(np.maximum(0.0, 1 - (self.pivots**2).sum(1)))
        self.between = self.distances(pivots)

    def _inner(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows / self.unit
        wide = min(rows.shape[1], self.pivots.shape[1])
        return rows[:, :wide] @ self.pivots[:, :wide].T, (rows**2).sum(1)

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Of candidates from every pivot."""
        inner, square = self._inner(rows)
        return np.sqrt(np.maximum(0.0, 2 - 2 * (inner + np.sqrt(np.maximum(0.0, 1 - square))[:, None] * self.extra)))

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors the nearest pivot, its distance, and their own square length."""
        inner, square = self._inner(rows)
        near = inner.argmax(1)
        return near, np.sqrt(np.maximum(0.0, square + 1 - 2 * inner[np.arange(len(rows)), near])) + EPS, square

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a row that has this score with an anchor of this square length; without end below all scores."""
        with np.errstate(over="ignore"):
            d = np.sqrt(np.maximum(0.0, square + 1 - 2 * (score.astype(np.float64) / self.unit) / self.unit))
        return np.where(score == vectors.LEAST, np.inf, d)

    def served(self, rows: np.ndarray, reach: np.ndarray, radius: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Which groups (rows x pivots) each candidate might serve; reach, radius, inner: of the groups, for each row."""
        d = self.distances(rows)
        own = d.argmin(1)
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 1e-3, (d**2 - d[np.arange(len(rows)), own][:, None] ** 2) / (2 * apart), 0.0)
        return (d <= reach + EPS) & (plane <= radius + PLANE_EPS) & (d >= inner - EPS)


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.array([] if x is None else x, dtype=np.int64) for x in batch.column(name).to_pylist()]


class Join:
    """What both joins share: the rows, the sample, the space."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, label: Column, is_anchor: Column, scale: int, n_positives: int, k: int, window: tuple[int, int]):
        self.spark: SparkSession = kernels.session(df)
        self.n_positives, self.k, self.window = n_positives, k, window
        frame = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label.alias("label")).filter(F.col("label").isNotNull())
        self.rows = kernels.cut(vectors.packed(frame, "id", "vec", scale, "label"))
        self.anchors = self.rows.filter(is_anchor).withColumn("akey", F.xxhash64("label", "vec")).dropDuplicates(["id", "akey", "label", "vec"])
        size = self.rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"), F.max("dim").alias("widest"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
        self.n, self.n_anchors = size.n, size.anchors
        if not self.n or not self.n_anchors:
            return
        n_seeds = max(16, min(SEEDS, (1 << 21) // max(1, size.widest)))
        sample = [r.asDict() for r in self.rows.orderBy(F.xxhash64("id", "label", "vec"), "id").limit(n_seeds).dropDuplicates(["id", "label", "vec"]).orderBy(F.xxhash64("id", "label", "vec"), "id").collect()]
        self.seed_ids, self.seeds = vectors.batches_of(sample)
        self.seed_labels = np.array([r["label"] for r in sample], dtype=np.int64)
        n_pivots = max(LEAST_PIVOTS, min(PIVOTS, self.n_anchors // PER_PIVOT, len(sample)))
        self.space = Space(np.unique(self.seeds[:n_pivots], axis=0), size.longest)
        self.shared = self.spark.sparkContext.broadcast((self.space, self.seed_ids, self.seeds, self.seed_labels))  # SEEDS rows, 2 M components

    def meet(self, homed: DataFrame, kernel: Callable[[pa.RecordBatch], _Positives | _Negatives], out: str, by_label: bool) -> DataFrame:
        """homed: anchors with grp, far, radius, inner.  Anchors and the candidates that might serve them, met by group."""
        homed = kernels.cut(homed)
        # at most CLASSES x PIVOTS rows
        groups = {r.grp: r for r in homed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("far") + F.col("radius")).alias("reach"), F.max("radius").alias("radius"), F.min(F.col("inner") - F.col("far")).alias("inner")).collect()}
        if not groups:
            return self.spark.createDataFrame([], out)
        shared, n_pivots = self.shared, len(self.space.pivots)
        n_groups = CLASSES * n_pivots if by_label else n_pivots
        reach, radius, inner = np.full(n_groups, -1.0), np.full(n_groups, -1.0), np.zeros(n_groups)
        blocks = np.zeros(n_groups, np.int64)
        for g, r in groups.items():
            reach[g], radius[g], inner[g], blocks[g] = r.reach, r.radius, r.inner, math.ceil(r.n / BLOCK)
        total = int(blocks.sum())
        slices = max(math.ceil(self.n / SLICE), min(math.ceil(2 * self.spark.sparkContext.defaultParallelism / total), math.ceil(self.n / 512)))
        first = np.concatenate(([0], np.cumsum(blocks * slices)))[:-1]

        def place(batches: vectors.Batches) -> vectors.Batches:
            """An anchor in a block of its group, for all slices."""
            turn = 0
            for batch in batches:
                (g,) = _numpy(batch, "grp")
                block = (turn + np.arange(len(g))) % np.maximum(1, blocks[g])
                turn += len(g)
                for s in range(slices):
                    yield pa.RecordBatch.from_arrays([pa.array((first[g] + block * slices + s).astype(np.int32)), pa.array(np.zeros(len(g), np.int32)), *(batch.column(c.split()[0]) for c in _GRID.split(", ")[2:])], names=[c.split()[0] for c in _GRID.split(", ")])

        def serve(batches: vectors.Batches) -> vectors.Batches:
            """A candidate for every block of the groups that it might serve, in one slice."""
            space = shared.value[0]
            turn = 0
            for whole in batches:
                for start in range(0, whole.num_rows, RUN):
                    batch = whole.slice(start, RUN)
                    dims, labels = _numpy(batch, "dim", "label")
                    group = (labels % CLASSES)[:, None] * n_pivots + np.arange(n_pivots) if by_label else np.broadcast_to(np.arange(n_pivots), (len(dims), n_pivots))
                    r, p = np.nonzero(space.served(vectors.matrix(dims, batch.column("vec")), reach[group], radius[group], inner[group]))
                    g = group[r, p]
                    slice_ = (turn + r) % slices
                    turn += batch.num_rows
                    many = blocks[g]
                    at = np.repeat(np.arange(len(g)), many)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    take, n = pa.array(r[at]), len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((first[g[at]] + block * slices + slice_[at]).astype(np.int32)), pa.array(np.ones(n, np.int32)), *(batch.column(c).take(take) for c in ("id", "label", "dim", "vec")),
                         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(3))],
                        names=[c.split()[0] for c in _GRID.split(", ")],
                    )

        grid = homed.mapInArrow(place, _GRID).unionByName(self.rows.select("id", "label", "dim", "vec").mapInArrow(serve, _GRID))
        return grid.repartition(total * slices, "task").sortWithinPartitions("task", "kind").mapInArrow(_stream(kernel), out)

    def positives(self) -> DataFrame:
        """``id, akey, n, other, score``: the n-th best of an anchor's label."""
        shared, n = self.shared, self.n_positives
        n_pivots = len(self.space.pivots)

        def home(batches: vectors.Batches) -> vectors.Batches:
            space, seed_ids, seeds, seed_labels = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, STEP):
                    batch = whole.slice(start, STEP)
                    ids, labels, dims = _numpy(batch, "id", "label", "dim")
                    rows = vectors.matrix(dims, batch.column("vec"))
                    near, far, square = space.home(rows)
                    best = vectors.Best(len(ids), n)
                    best.offer_all(np.arange(len(ids)), vectors.products(rows, seeds), seed_ids, (ids[:, None] == seed_ids) | (labels[:, None] != seed_labels))
                    yield _homed(batch, (labels % CLASSES) * n_pivots + near, far, space.radius(square, best.floor) + EPS, np.zeros(len(ids)), [[]] * len(ids), [[]] * len(ids), [[int(x)] for x in best.floor])

        homed = self.anchors.withColumns({"n": F.lit(0), "ids": F.array().cast("array<long>"), "scores": F.array().cast("array<long>")}).mapInArrow(home, _HOMED)
        met = self.meet(homed, lambda block: _Positives(block, n), "id long, akey long, n int, other long, score long", by_label=True)
        best = Window.partitionBy("id", "akey").orderBy(F.desc("score"), "other")
        return met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= n)

    def negatives(self, positives: DataFrame) -> DataFrame:
        """``id, akey, n, positive, positive_score, other, score``: candidates for the negatives of each positive, at least the k best of each."""
        shared, k, (lo, hi) = self.shared, self.k, self.window
        each = positives.groupBy("id", "akey").agg(F.array_sort(F.collect_list(F.struct("n", "other", "score"))).alias("p"))  # n_positives each
        anchors = self.anchors.join(each, ["id", "akey"]).withColumns({"n": F.lit(0), "ids": F.col("p.other"), "scores": F.col("p.score")})

        def home(batches: vectors.Batches) -> vectors.Batches:
            space, seed_ids, seeds, seed_labels = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, STEP):
                    batch = whole.slice(start, STEP)
                    dims, labels = _numpy(batch, "dim", "label")
                    rows, pairs = vectors.matrix(dims, batch.column("vec")), _lists(batch, "scores")
                    near, far, square = space.home(rows)
                    at, high, best = _pairs(pairs, [share(lo, x, True) for x in pairs], k, hi)
                    scores = vectors.products(rows, seeds)
                    best.offer_all(np.arange(len(at)), scores[at], seed_ids, (labels[at][:, None] == seed_labels) | (scores[at] > high[:, None]))
                    good = high >= best.floor
                    low, top = np.full(len(rows), vectors.LEAST), np.full(len(rows), vectors.LEAST)
                    low[:], some = np.iinfo(np.int64).max, np.zeros(len(rows), bool)
                    np.minimum.at(low, at[good], best.floor[good])
                    np.maximum.at(top, at[good], high[good])
                    some[at[good]] = True
                    ends = np.searchsorted(at, np.arange(len(rows) + 1))
                    lows = [best.floor[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    keep = np.flatnonzero(some)
                    if len(keep):
                        yield _homed(batch.take(pa.array(keep)), near[keep], far[keep], space.radius(square, low)[keep] + EPS, np.maximum(0.0, space.radius(square, top)[keep] - EPS), [x for x, y in zip(batch.column("ids").to_pylist(), some, strict=True) if y], [pairs[x].tolist() for x in keep], [lows[x] for x in keep])

        out = "id long, akey long, n int, positive long, positive_score long, other long, score long"
        return self.meet(anchors.mapInArrow(home, _HOMED), lambda block: _Negatives(block, k, hi), out, by_label=False)


_HOMED = "id long, label long, dim int, vec binary, akey long, n int, ids array<long>, scores array<long>, lows array<long>, grp int, far double, radius double, inner double"


def _homed(batch: pa.RecordBatch, group: np.ndarray, far: np.ndarray, radius: np.ndarray, inner: np.ndarray, ids: list, scores: list, lows: list) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("id", "label", "dim", "vec", "akey", "n")), pa.array(ids, longs), pa.array(scores, longs), pa.array(lows, longs), pa.array(group.astype(np.int32)), pa.array(far), pa.array(radius), pa.array(inner)],
        names=[c.split()[0] for c in _HOMED.split(", ")],
    )


def _pairs(pairs: list[np.ndarray], lows: list[np.ndarray], k: int, hi: int) -> tuple[np.ndarray, np.ndarray, vectors.Best]:
    """Of the positives of several anchors, in turn: the anchor, the highest score allowed, and the best so far."""
    at = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
    flat = np.concatenate([np.zeros(0, np.int64), *pairs])
    return at, share(hi, flat, False), vectors.Best(len(at), k, np.concatenate([np.zeros(0, np.int64), *lows]))


class _Block:
    """Anchors of one task."""

    def __init__(self, block: pa.RecordBatch):
        self.ids, self.labels, dims, self.akeys = _numpy(block, "id", "label", "dim", "akey")
        self.rows = vectors.matrix(dims, block.column("vec"))
        self.lows, self.scores, self.others = _lists(block, "lows"), _lists(block, "scores"), _lists(block, "ids")


class _Positives(_Block):
    def __init__(self, block: pa.RecordBatch, n: int):
        super().__init__(block)
        self.best = vectors.Best(len(self.ids), n, np.array([x[0] for x in self.lows]))

    def take(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for s in range(0, len(self.ids), STEP):
            a = slice(s, s + STEP)
            barred = (self.ids[a, None] == ids) | (self.labels[a, None] != labels)
            self.best.offer_all(np.arange(len(self.ids))[a], vectors.products(self.rows[a], rows), ids, barred)

    def result(self) -> pa.RecordBatch:
        row, ids, scores = self.best.rows()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.akeys[row]), pa.array(np.zeros(len(row), np.int32)), pa.array(ids), pa.array(scores)], names=["id", "akey", "n", "other", "score"])


class _Negatives(_Block):
    def __init__(self, block: pa.RecordBatch, k: int, hi: int):
        super().__init__(block)
        self.at, self.high, self.best = _pairs(self.scores, self.lows, k, hi)
        self.first = np.searchsorted(self.at, np.arange(len(self.ids) + 1))

    def take(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for s in range(0, len(self.ids), STEP):
            a, b = self.first[s], self.first[min(s + STEP, len(self.ids))]
            at, scores = self.at[a:b] - s, vectors.products(self.rows[s : s + STEP], rows)
            barred = (self.labels[s : s + STEP][at][:, None] == labels) | (scores[at] > self.high[a:b, None])
            self.best.offer_all(np.arange(a, b), scores[at], ids, barred)

    def result(self) -> pa.RecordBatch:
        pair, ids, scores = self.best.rows()
        row = self.at[pair]
        n = pair - self.first[row] + 1
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])[pair]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[row], self.akeys[row], n.astype(np.int32), flat(self.others), flat(self.scores), ids, scores)], names=["id", "akey", "n", "positive", "positive_score", "other", "score"])


def _stream(kernel: Callable[[pa.RecordBatch], _Positives | _Negatives]) -> vectors.Kernel:
    """Rows sorted by task and kind: a block of anchors, then the candidates for it, batch by batch."""

    def run(batches: vectors.Batches) -> vectors.Batches:
        task, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks, kinds = _numpy(batch, "task", "kind")
            edges = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if int(tasks[a]) != task:
                    if block is not None:
                        yield block.result()
                    task, held, block = int(tasks[a]), [], None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(piece)
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = kernel(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                for s in range(0, piece.num_rows, RUN):
                    some = piece.slice(s, RUN)
                    ids, labels, dims = _numpy(some, "id", "label", "dim")
                    block.take(ids, labels, vectors.matrix(dims, some.column("vec")))
        if block is not None:
            yield block.result()

    return run


def mine(df: DataFrame, id_col: str, vec_col: str, label: Column, is_anchor: Column, scale: int = 256, n_positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    label: over the frame's own columns; is_anchor: over a column ``id``.  A negative's score is from window[0] to
    window[1] per cent of the positive's.
    """
    join = Join(df, id_col, vec_col, label, is_anchor, scale, n_positives, k, window)
    if not join.n or not join.n_anchors:
        return join.spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    found = join.negatives(kernels.cut(join.positives()))
    best = Window.partitionBy("id", "akey", "n").orderBy(F.desc("score"), "other")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"), F.col("n").alias("positive_rank"),
    )
