"""Structured warnings: ``{code, message, details}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def warning(code: str, message: str | Column, details: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), text.alias("message"), (F.lit(None).cast("string") if details is None else details).alias("details"))


def compact(*items: Column) -> Column:
    """The warnings that are there, in the given order."""
    return F.array_compact(F.array(*items))


def codes(warnings: str | Column) -> Column:
    """Sorted codes, repeats kept."""
    return F.array_sort(F.transform(warnings, lambda w: w["code"]))
