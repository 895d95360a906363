"""Vectors as rows of whole numbers: packing, unpacking, exact inner products and the best of many scores.

A component x becomes floor(scale * x).  Rows whose vector is null, or holds a null or non-finite
component (also after scaling), are left out, and so are rows without an id, which nothing could name.
Packed vectors take 2, 4 or 8 bytes a component, whatever the largest of their batch needs; the width
follows from the length.  Vectors of different lengths are compared over the components that both have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

PACKED = "id long, label long, dim int, vec binary, norm double, peak double"
#: Below every score.
LEAST = np.int64(-(2**63))
#: Doubles hold every whole number up to here.
EXACT = 2.0**53
_TYPES = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}


def packed(df: DataFrame, id_col: str, vec_col: str, scale: int, label_col: str | None = None) -> DataFrame:
    """``PACKED`` rows of the vectors that take part; peak is the largest component's size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            ok = vecs.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            dims = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(vecs).cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            row = np.repeat(np.arange(len(dims)), dims)
            ok[np.unique(row[~np.isfinite(flat)])] = False
            flat, row, dims = flat[ok[row]], row[ok[row]], dims[ok]
            n = len(dims)
            if not n:
                continue
            at = (np.cumsum(ok) - 1)[row]
            peak = np.zeros(n)
            np.maximum.at(peak, at, np.abs(flat))
            with np.errstate(over="ignore"):
                norm = np.minimum(peak * np.sqrt(np.bincount(at, (flat / np.maximum(peak, 1)[at]) ** 2, n)) if len(flat) else peak, np.finfo(np.float64).max)
            kind = _TYPES[2 if (most := peak.max()) < 2**15 else 4 if most < 2**31 else 8]
            ends = np.concatenate(([0], np.cumsum(dims * kind.itemsize))).astype(np.int64)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(kind).tobytes())]).cast(pa.binary())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep).cast(pa.int64()), batch.column(1).filter(keep).cast(pa.int64()), pa.array(dims.astype(np.int32)), binary, pa.array(norm), pa.array(peak)],
                names=["id", "label", "dim", "vec", "norm", "peak"],
            )

    kernels.session(df)
    label = F.col(label_col) if label_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"))
    return rows.mapInArrow(pack, PACKED)


def matrix(dims: np.ndarray, vecs: pa.Array) -> np.ndarray:
    """Packed vectors as the rows of a matrix of doubles; shorter ones end in zeros."""
    n, wide = len(dims), int(dims.max(initial=0))
    if not n or not wide:
        return np.zeros((n, wide))
    sizes = pc.binary_length(vecs).to_numpy(zero_copy_only=False)
    if (dims == wide).all() and (sizes == sizes[0]).all():
        return np.frombuffer(b"".join(vecs.to_pylist()), dtype=_TYPES[int(sizes[0]) // wide]).reshape(n, wide).astype(np.float64)
    out = np.zeros((n, wide))
    for k, (d, x) in enumerate(zip(dims.tolist(), vecs.to_pylist(), strict=True)):
        if d:
            out[k, :d] = np.frombuffer(x, dtype=_TYPES[len(x) // d])
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both: doubles where those are exact, else whole numbers, held at the limits of a long."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if not wide or not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    with np.errstate(over="ignore"):
        small = np.abs(a).max() * np.abs(b).max() * wide < EXACT
    if small:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    exact = np.dot(whole(a), whole(b).T)
    return np.frompyfunc(lambda x: max(-(2**63), min(2**63 - 1, x)), 1, 1)(exact).astype(np.int64)


class Best:
    """For each of n rows the k best of the scores offered so far: higher first, then the smaller id.  floor: a score below it is of no use to the row."""

    __slots__ = ("floor", "ids", "k", "scores")

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n, LEAST) if floor is None else floor.astype(np.int64)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate((self.scores[row], scores.astype(np.int64)))
        ids = np.concatenate((self.ids[row], ids))
        if len(scores) > 4 * self.k:  # most of them at once, ties at the cut kept
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[row] = max(self.floor[row], self.scores[row][-1])

    def offer_all(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, barred: np.ndarray | None = None) -> None:
        """A block of scores (rows x ids); barred: pairs that take no part."""
        good = scores >= self.floor[rows][:, None]
        if barred is not None:
            good &= ~barred
        r, c = np.nonzero(good)
        ends = np.searchsorted(r, np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            at = c[ends[k] : ends[k + 1]]
            self.offer(int(rows[k]), scores[k, at], ids[at])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, id, score of everything held."""
        sizes = [len(x) for x in self.ids]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), join(self.ids), join(self.scores)


def least_useful(score: np.ndarray) -> np.ndarray:
    """A score as a bound for pruning by lengths: a little lower, for the rounding of lengths."""
    score = score.astype(np.float64)
    return score - np.abs(score) * 1e-9


def batches_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """ids and matrix of collected packed rows."""
    dims = np.array([r["dim"] for r in rows], dtype=np.int64)
    return np.array([r["id"] for r in rows], dtype=np.int64), matrix(dims, pa.array([bytes(r["vec"]) for r in rows], type=pa.binary()))


Batches = Iterator[pa.RecordBatch]
Kernel = Callable[[Batches], Batches]
