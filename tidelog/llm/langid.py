"""Language identification with string kernels.

Texts are compared by a blended-spectrum presence kernel: the number of byte n-grams
(1 to ``ORDER`` bytes of the lower-cased text) that both have, divided by the root of the product of
their own numbers.  The n-grams are the ``GRAMS`` ones whose presence differs most between languages.
``LANDMARKS`` training texts of each language give a Nyström map; one-versus-rest kernel ridge regression
on it gives a weight for each landmark and language.  A batch is scored by two matrix
products: presence by landmarks, then kernel by languages.

Training reads about ``PER_LANGUAGE`` labelled texts of each language, chosen by a hash of the id,
whatever the size of the corpus; prediction reads every whole text and nothing else.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there
is nothing to learn from; ties go to the first language in order; repeated rows are predicted
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

ORDER = 4
GRAMS = 4096
PER_LANGUAGE = 500
#: Texts of all languages together, about, where there are many.
MOST_TEXTS = 20_000
#: Landmarks of each language, and of all together; a language has one at least.
LANDMARKS, MOST_LANDMARKS = 48, 8192
#: Languages whose sampling shares are sent to every task; more are joined.
BROADCAST_LABELS = 100_000
RIDGE = 1.0
LEAST_DF = 5
_LATIN = re.compile("[A-Za-z]")
_SLOTS = 22


def held_out(id_col: str) -> Column:
    """Rows kept out of learning: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def _bytes(texts: list[str | None]) -> np.ndarray:
    """Lower-cased texts; 0xFF, which UTF-8 never has, ends each."""
    return np.frombuffer(b"".join((x or "").lower().encode("utf-8", "replace") + b"\xff" for x in texts), dtype=np.uint8)


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """Every n-gram as a number; the order is in the high bits."""
    n = len(data) - order + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(order):
        out |= data[i : i + len(out)].astype(np.uint64) << np.uint64(8 * i)
    return out | np.uint64(order << 40)


class Grams:
    """The chosen n-grams in a table without collisions."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        mult = int(kernels._MUL)
        while True:
            self.mult = np.uint64(mult)
            slot = self._slot(self.keys)
            if len(np.unique(slot)) == len(slot):
                break
            mult = (mult * 6364136223846793005 + 2) % 2**64 | 1
        self.number = np.full(1 << _SLOTS, -1, dtype=np.int16)
        self.number[slot] = np.arange(len(slot))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.mult) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def presence(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), max(1, len(self.keys))), dtype=np.float32)
        data = _bytes(texts)
        text = np.cumsum(data == 0xFF)
        text -= data == 0xFF
        for order in range(1, ORDER + 1):
            k = _keys(data, order)
            f = self.number[self._slot(k)]
            at = np.flatnonzero(f >= 0)
            at = at[self.keys[f[at]] == k[at]]
            x[text[at], f[at]] = 1
        return x


class Model:
    """Landmark presences and, for each landmark and language, a weight."""

    def __init__(self, grams: Grams, x: np.ndarray, y: list[str]):
        self.grams = grams
        self.langs = sorted(set(y))
        x = self._unit(x)
        y = np.array(y)
        # the first texts of each language
        turn = np.zeros(len(y), dtype=np.int64)
        for c in self.langs:
            turn[y == c] = np.arange((y == c).sum())
        at = np.flatnonzero(turn < max(1, min(LANDMARKS, MOST_LANDMARKS // len(self.langs))))
        self.landmarks = x[at]
        k = (self.landmarks @ self.landmarks.T).astype(np.float64)
        values, vectors = np.linalg.eigh(k)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = (x @ self.landmarks.T).astype(np.float64) @ root
        z1 = np.concatenate((z, np.ones((len(z), 1))), axis=1)
        target = np.where(y[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        beta = np.linalg.solve(z1.T @ z1 + RIDGE * np.eye(z1.shape[1]), z1.T @ target)
        self.weights = (root @ beta[:-1]).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        kernel = self._unit(self.grams.presence(texts)) @ self.landmarks.T
        f = kernel @ self.weights + self.bias
        best = f.argmax(axis=1)
        score = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1).astype(np.float64)
        lettered = [has_letter(t) for t in texts]
        langs = [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return langs, [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]


def sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """rows (id, text, label): about per_label of each label, by a hash of the id."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    part = F.lit(float(per_label)) / F.col("n")
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(n) if n.count() <= BROADCAST_LABELS else n, label).filter(spread < part).select(*rows.columns)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    spark = kernels.session(docs)
    rows = docs.filter(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and lang <> 'und' and text is not null")
    labels = max(1, rows.select("lang").distinct().count())
    chosen = kernels.cut(sample(rows, "lang", max(1, min(PER_LANGUAGE, MOST_TEXTS // labels))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            for c in sorted(set(langs)):
                seen = []
                for t in (t for t, x in zip(texts, langs, strict=True) if x == c):
                    data = _bytes([t])[:-1]
                    seen += [np.unique(_keys(data, n)) for n in range(1, ORDER + 1)]
                keys, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([c] * len(keys), pa.string()), pa.array(n.astype(np.int64))], names=["k", "lang", "n"])

    sizes = kernels.cut(chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    n_labels = sizes.count()
    if not n_labels:
        return None
    # how often each label's texts have a gram; a label that lacks it has no row
    per = chosen.mapInArrow(count, "k long, lang string, n long").groupBy("k", "lang").agg(F.sum("n").alias("n")).join(sizes, "lang").withColumn("rate", F.col("n") / F.col("size"))
    df = per.groupBy("k").agg(F.max("rate").alias("most"), F.when(F.count(F.lit(1)) == n_labels, F.min("rate")).otherwise(0.0).alias("least"), F.sum("n").alias("df"))
    gap = F.col("most") - F.col("least") if n_labels > 1 else F.col("most")
    keys = df.filter(F.col("df") >= LEAST_DF).orderBy(F.desc(gap), "k").limit(GRAMS).select("k").collect()
    grams = Grams(np.array([r["k"] for r in keys], dtype=np.int64))
    shared = spark.sparkContext.broadcast(grams)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            x = np.packbits(shared.value.presence(b.column(1).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])

    got = chosen.mapInArrow(bits, "id long, lang string, x binary").orderBy(F.xxhash64("id"), "id", "x").collect()
    width = max(1, len(grams.keys))
    x = np.stack([np.unpackbits(np.frombuffer(r["x"], dtype=np.uint8))[:width] for r in got]).astype(np.float32)
    return Model(grams, x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score`` for each row."""
    spark = kernels.session(docs)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    if model is None:
        return src.select("id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                langs, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
