"""Timestamps as text, their canonical form, and durations in whole seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.warn import compact, warning

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: Accepted forms without a zone: date and time of day to the minute or second, with a space or T between.
ZONELESS = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?$"


def parse(c: Column) -> Column:
    """A timestamp from RFC 3339 text, else null."""
    return F.when(c.rlike(RFC3339), F.upper(c).try_cast("timestamp"))


def render(ts: Column) -> Column:
    """Canonical text: UTC, ``Z``, a fraction only if there is one (session time zone UTC)."""
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def trimmed(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def reading(cell: Column) -> dict[str, Column]:
    """What a cell says: its text, and the time read exactly or by an allowed form, and that form's name."""
    v = trimmed(cell)
    between = F.when(v.contains("T"), "T").otherwise(" ")
    form = F.concat(F.lit("[year]-[month]-[day]"), between, F.lit("[hour]:[minute]"), F.when(F.length(v) > 16, ":[second]").otherwise(""))
    return {"text": v, "exact": parse(v), "assumed": F.when(v.rlike(ZONELESS), v.try_cast("timestamp")), "form": form}


def normalized(field: str, r: Column) -> dict[str, Column]:
    """``canonical``, ``raw`` and ``warnings`` of a reading (a struct).  Nothing is guessed: only the allowed forms are read, with warnings."""
    v, exact, assumed = r["text"], r["exact"], r["assumed"]
    loose = exact.isNull() & assumed.isNotNull()
    canonical = render(F.coalesce(exact, assumed))
    bad = v.isNotNull() & exact.isNull() & assumed.isNull()
    return {
        "canonical": canonical,
        "raw": F.when(exact.isNull(), v),
        "warnings": compact(
            F.when(loose, warning("INGEST_TS_TZ_ASSUMED_UTC", f"Assumed UTC timezone for {field}", F.concat(F.lit("value="), v, F.lit("; fmt="), r["form"]))),
            F.when(loose, warning("INGEST_TS_NORMALIZED", f"Normalized non-RFC3339 timestamp for {field}", F.concat(F.lit("raw="), v, F.lit("; canonical="), canonical))),
            F.when(bad, warning("INGEST_TS_UNPARSEABLE", f"Unparseable timestamp for {field}; preserved raw", F.concat(F.lit("raw="), v))),
        ),
    }


def once(frame: DataFrame) -> DataFrame:
    """The same rows, computed once: later expressions refer to the columns instead of repeating what made them."""
    return frame.select(F.inline(F.array(F.struct("*"))))


def normalize(frame: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each field becomes its canonical form, with ``{field}_raw``, ``{field}_given`` and ``{field}_warnings``."""
    read = once(frame.withColumns({f"__{f}": F.struct(*[c.alias(k) for k, c in reading(F.col(f)).items()]) for f in fields}))
    new: dict[str, Column] = {}
    for f in fields:
        x = normalized(f, F.col(f"__{f}"))
        new |= {f: x["canonical"], f"{f}_raw": x["raw"], f"{f}_warnings": x["warnings"], f"{f}_given": F.col(f"__{f}")["text"].isNotNull()}
    return once(read.withColumns(new).drop(*[f"__{f}" for f in fields]))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, cut toward zero; may be negative."""
    return F.call_function("div", F.unix_micros(b) - F.unix_micros(a), F.lit(1_000_000))


def duration_text(s: Column) -> Column:
    """``UNKNOWN``, ``{h}h {m}m``, ``{m}m {s}s`` or ``{s}s``."""
    m = F.floor(s / 60)
    hours = F.format_string("%dh %dm", F.floor(m / 60), m % 60)
    return F.when(s.isNull(), "UNKNOWN").when(m >= 60, hours).when(m >= 1, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


#: Upper bound (inclusive) in seconds, key, label; the last two have no bound.
BUCKETS = ((300, "le_5m", "0-5m"), (900, "le_15m", "5-15m"), (3600, "le_1h", "15m-1h"), (14400, "le_4h", "1h-4h"), (86400, "le_24h", "4h-24h"))
OVER = ("gt_24h", ">24h")
UNKNOWN_BUCKET = ("unknown", "UNKNOWN (unparseable/missing)")
BUCKET_KEYS = [k for _, k, _ in BUCKETS] + [OVER[0], UNKNOWN_BUCKET[0]]
BUCKET_LABELS = dict(zip(BUCKET_KEYS, [x for _, _, x in BUCKETS] + [OVER[1], UNKNOWN_BUCKET[1]], strict=True))


def bucket(s: Column) -> Column:
    out = F.when(s.isNull(), UNKNOWN_BUCKET[0])
    for top, key, _ in BUCKETS:
        out = out.when(s <= top, key)
    return out.otherwise(OVER[0])


def bucket_rank(key: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in BUCKET_KEYS]), key)


def bucket_label(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, label in BUCKET_LABELS.items():
        out = F.when(key == k, label).otherwise(out)
    return out


def epoch_text(c: Column) -> Column:
    """Canonical text of ``seconds[.fraction]``: whole seconds and up to nine digits, no floating point; else null."""
    form = r"^([+-]?\d+)(?:\.(\d*))?$"
    v = trimmed(c)
    whole = F.nullif(F.regexp_extract(v, form, 1), F.lit("")).try_cast("bigint")
    nanos = F.regexp_replace(F.substring(F.regexp_extract(v, form, 2), 1, 9), "0+$", "")
    text = F.replace(F.timestamp_seconds(whole).cast("string"), F.lit(" "), F.lit("T"))
    return F.when(v.rlike(form), F.concat(text, F.when(nanos != "", F.concat(F.lit("."), nanos)).otherwise(F.lit("")), F.lit("Z")))


def file_safe(c: Column) -> Column:
    """A time as part of a file name: everything but ASCII letters and digits is ``_``."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")
