"""Shared text kernels: Arrow batch slicing and vectorised word tables.

The kernels run inside ``mapInArrow`` tasks.  They hold one slice of a batch
at a time (``SLICE_BYTES`` of text, or a single longer document), so a task's
memory does not depend on how many rows a partition has.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once inside a task.
SLICE_BYTES = 2_000_000

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xFF51AFD7ED558CCD)

#: Byte table: true for the white space that separates words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, with this package within reach of the Python workers: by path where they share the driver's disk, else
    as a file that Spark sends them."""
    spark = df.sparkSession
    root = Path(__file__).resolve().parents[2]
    if spark.sparkContext.master.startswith("local"):
        env = spark.sparkContext.environment
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH", "")) if x)
    elif spark.sparkContext.applicationId not in _SENT:
        spark.sparkContext.addPyFile(packed(root))
        _SENT.add(spark.sparkContext.applicationId)
    return spark


_SENT: set[str] = set()


def packed(root: Path) -> str:
    """This package as a zip file on the driver, from where Spark sends it to executors."""
    path = Path(tempfile.mkdtemp()) / "tidelog.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.glob("tidelog/**/*.py")):
            z.write(f, f.relative_to(root))
    return str(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one where a local session names none, an error where a cluster does not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs a folder that all executors share in spark.checkpoint.dir")
    return found or os.path.join(tempfile.gettempdir(), "tidelog-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again.

    The result has no lineage beyond its files, so losing an executor repeats
    no earlier stage, and each reader scans files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidelog/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str, prefix: str = "__") -> list[str]:
    """A column name like each wanted one that the frame does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        free = f"{prefix}{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of plans no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice has more than ``limit`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = text_sizes(batch.column(column))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return [x or b"" for x in texts.to_pylist()]


class Words:
    """Words of several texts as flat arrays.

    data: all bytes, a space after each text; start, end: byte offsets of each
    word; first: index of each text's first word, one more entry than texts.
    """

    __slots__ = ("data", "start", "end", "first", "offsets", "space")

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        sizes = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.space = IS_SPACE[self.data]
        edge = np.diff(self.space.astype(np.int8), prepend=np.int8(1))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(self.end) < len(self.start):  # cannot happen: a space ends the data
            self.end = np.append(self.end, len(self.data))
        self.first = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)

    def texts_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


#: Random but fixed values for bytes, from a seeded generator.
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_P = U64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_P_INV = U64(pow(int(_P), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all bits."""
    h = h ^ (h >> U64(32))
    h = h * _MIX
    return h ^ (h >> U64(29))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans by differences of a running polynomial, 2 M bytes at a time exact modulo 2**64."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    n = len(data)
    run = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _powers(_P, n), out=run[1:])
    h = (run[end] - run[start]) * _powers(_P_INV, n + 1)[start]
    return finish(h + (end - start).astype(U64) * _MUL)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; len(words) - k + 1 values, or none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = np.zeros(n, dtype=U64)
    for i in range(k):
        h *= _MIX
        h += words[i : i + n]
        h ^= h >> U64(31)
    return finish(h)


def whole_windows(words: Words, k: int) -> np.ndarray:
    """For each of the len(words) - k + 1 windows, whether it lies inside one text."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    t = words.texts_of_words()
    return t[:n] == t[k - 1 :]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum values (one for each word or line) by text."""
    run = np.concatenate(([0], np.cumsum(values)))
    return run[first[1:]] - run[first[:-1]]
