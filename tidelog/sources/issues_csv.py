"""Issue-tracker CSV: header row, quoted fields, columns chosen by a mapping.  Every column is read as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import TidelogError
from tidelog.functions import incident as inc
from tidelog.functions import times
from tidelog.functions.warn import compact, warning
from tidelog.schema import MOMENTS, PERCENTS, TEXTS, WARNINGS
from tidelog.sources import csv_ranges

BAD = "_corrupt_record"
FIELDS = (*TEXTS, *PERCENTS, *MOMENTS)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line, in order, repeats included."""
    first = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise TidelogError("INGEST_CSV_HEADERS_FAILED", "Failed to read CSV headers", path)
    return [x or "" for x in first[0]]


def read(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """``row`` (0-based) and every column as text ``c0, c1, ...``; rows of another width carry ``_corrupt_record``.

    A file is one partition, as Spark's reader has it where quoted fields may span lines; many files are read in parallel.  For one large
    file there is ``read_ranges``.
    """
    n = len(header(spark, path))
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(n)]
    if mode == "PERMISSIVE":
        fields.append(T.StructField(BAD, T.StringType()))
    reader = spark.read.schema(T.StructType(fields)).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", mode)
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", BAD)
    return reader.csv(path).withColumn("row", F.monotonically_increasing_id())


def read_ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """As ``read``, with many tasks for each file; rows are numbered from 0 through the files in order of their paths.  In
    ``_corrupt_record`` lines end with line feeds, whatever they end with in the file."""
    names = [f"c{i}" for i in range(len(header(spark, path)))]
    rows = csv_ranges.rows(spark, path, range_bytes).withColumn("x", csv_ranges.fields(F.col("text"), names, BAD))
    return rows.select("row", "x.*")


def preview(spark: SparkSession, path: str, max_rows: int) -> tuple[list[str], list[list[str]]]:
    """Headers and the first rows; any bad row is an error."""
    names = header(spark, path)
    try:
        rows = read(spark, path, "FAILFAST").limit(max_rows).select(F.array(*[F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(len(names))]).alias("x")).collect()
    except Exception as e:
        raise TidelogError("INGEST_CSV_PREVIEW_FAILED", "Failed to read a CSV row", str(e)[:300]) from e
    return names, [list(r["x"]) for r in rows]


def mapped(rows: DataFrame, names: list[str], mapping: Mapping[str, str | None]) -> DataFrame:
    """``row, bad`` and the mapped fields: first column of exactly that name, trimmed, empty is null."""
    if not mapping.get("title"):
        raise TidelogError("INGEST_MAPPING_INVALID", "The mapping needs a title column")

    def pick(field: str) -> Column:
        name = mapping.get(field)
        return times.trimmed(F.col(f"c{names.index(name)}")) if name in names else F.lit(None).cast("string")

    bad = F.col(BAD).isNotNull() if BAD in rows.columns else F.lit(False)
    return rows.select("row", bad.alias("bad"), *[pick(f).alias(f) for f in FIELDS])


def staged(cells: DataFrame) -> DataFrame:
    """Typed rows: percentages, canonical and raw moments, which moments were given, fingerprint, row warnings."""
    out = times.normalize(cells, MOMENTS)
    row = F.concat(F.lit("row="), F.col("row").cast("string"))
    warnings: list[Column] = []
    for m in MOMENTS:
        stored = F.when(F.col(f"{m}_raw").isNotNull() & F.col(m).isNull(), warning("INGEST_TS_RAW_STORED", f"{m} was kept as it was written, as its time is not certain", row))
        warnings += [F.col(f"{m}_warnings"), compact(stored)]
    for p in PERCENTS:
        x = inc.percent(F.col(p), p)
        out = out.withColumns({f"__c_{p}": x["value"], f"__w_{p}": x["warnings"]})
        warnings.append(F.col(f"__w_{p}"))
    title = compact(warning("INGEST_MISSING_TITLE", "The row has no title", row))
    broken = compact(warning("INGEST_CSV_PARSE_FAILED", "The row does not fit the header", row))
    out = out.withColumn("row_warnings", F.when(F.col("bad"), broken).when(F.col("title").isNull(), title).otherwise(F.concat(*warnings)).cast(WARNINGS))
    out = out.withColumns({p: F.col(f"__c_{p}") for p in PERCENTS}).withColumn("fingerprint", inc.fingerprint())
    return times.once(out.drop(*[c for c in out.columns if c.startswith("__") or c.endswith("_warnings") and c != "row_warnings"]))
