"""Per-incident expressions: metrics, validation, impact, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.functions.warn import compact, warning
from tidelog.schema import MOMENTS, PERCENTS

BIGINT_MAX = 9223372036854775807


def clock(ts: Column) -> Column:
    """A timestamp as warnings show it."""
    part = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd H:mm:ss"), F.lit("."), F.when(part == "", "0").otherwise(part), F.lit(" +00:00:00"))


def _t(m: str) -> Column:
    return times.parse(F.col(m))


#: metric -> (from, to)
PAIRS = {
    "mttd_seconds": ("start_ts", "first_observed_ts"),
    "it_awareness_lag_seconds": ("first_observed_ts", "it_awareness_ts"),
    "mtta_seconds": ("it_awareness_ts", "ack_ts"),
    "time_to_mitigation_seconds": ("ack_ts", "mitigate_ts"),
}


def _not_negative(s: Column) -> Column:
    return F.when(s >= 0, s)


def metrics() -> dict[str, Column]:
    """The five response metrics in seconds; null where a moment is missing or the order is wrong.

    Resolve time counts from the start, and from the first observation only where the start is unknown.
    """
    out = {m: _not_negative(times.seconds_between(_t(a), _t(b))) for m, (a, b) in PAIRS.items()}
    begin = F.coalesce(_t("start_ts"), _t("first_observed_ts"))
    return out | {"mttr_seconds": _not_negative(times.seconds_between(begin, _t("resolve_ts")))}


def with_metrics(incidents: DataFrame) -> DataFrame:
    return incidents.withColumns(metrics())


def metric_warnings() -> Column:
    """Moments that do not parse, then pairs in the wrong order."""
    items = [F.when(F.col(m).isNotNull() & _t(m).isNull(), warning("METRICS_TS_PARSE_FAILED", f"Failed to parse {m} for metrics", F.concat(F.lit("value="), F.col(m)))) for m in MOMENTS]
    for a, b in PAIRS.values():
        items.append(_late(a, b, times.seconds_between(_t(a), _t(b)) < 0))
    whole = times.seconds_between(_t("start_ts"), _t("resolve_ts")) < 0
    late = times.seconds_between(_t("first_observed_ts"), _t("resolve_ts")) < 0
    items += [_late("start_ts", "resolve_ts", whole), _late("first_observed_ts", "resolve_ts", _t("start_ts").isNull() & late)]
    return compact(*items)


def _late(a: str, b: str, when: Column) -> Column:
    details = F.concat(F.lit(f"{a}="), clock(_t(a)), F.lit(f"; {b}="), clock(_t(b)))
    return F.when(when, warning("METRICS_TS_ORDER_VIOLATION", f"Cannot compute metric: {a} must be <= {b}", details))


def validation_warnings() -> Column:
    """Raw values without a canonical one, moments that do not parse, moments out of order, percentages out of range."""
    items = []
    for m in MOMENTS:
        items.append(F.when(F.col(m).isNull() & F.col(f"{m}_raw").isNotNull(), warning("VALIDATION_TS_RAW_PRESENT", f"Non-canonical timestamp preserved for {m}; canonical is UNKNOWN", F.concat(F.lit("raw="), F.col(f"{m}_raw")))))
    for m in MOMENTS:
        items.append(F.when(F.col(m).isNotNull() & _t(m).isNull(), warning("VALIDATION_TS_PARSE_FAILED", f"Failed to parse {m}", F.concat(F.lit("value="), F.col(m)))))
    for a, b in zip(MOMENTS, MOMENTS[1:], strict=False):
        details = F.concat(F.lit(f"{a}="), clock(_t(a)), F.lit(f"; {b}="), clock(_t(b)))
        items.append(F.when(_t(a) > _t(b), warning("VALIDATION_TS_ORDER_VIOLATION", f"Timestamp order violation: {a} must be <= {b}", details)))
    for p in PERCENTS:
        items.append(F.when(~F.col(p).between(0, 100), warning("VALIDATION_PCT_OUT_OF_RANGE", f"{p} out of range", F.concat(F.lit("value="), F.col(p).cast("string")))))
    return compact(*items)


def pain(impact: Column, health: Column, mttr: Column) -> Column:
    """``impact * (100 - health) * mttr``; null where any is unknown, out of range or negative; never above the largest bigint."""
    known = impact.between(0, 100) & health.between(0, 100) & (mttr >= 0)
    product = impact.cast("decimal(38,0)") * (F.lit(100) - health).cast("decimal(10,0)") * mttr.cast("decimal(20,0)")
    return F.when(known, F.least(product.cast("decimal(38,0)"), F.lit(BIGINT_MAX).cast("decimal(38,0)")).cast("bigint"))


def category(c: str | Column) -> Column:
    """Unknown is a category of its own."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("UNKNOWN"))


def saturating_sum(c: Column) -> Column:
    total = F.sum(c.cast("decimal(38,0)"))
    top = F.lit(BIGINT_MAX).cast("decimal(38,0)")
    return F.coalesce(F.when(total > top, top).otherwise(total).cast("bigint"), F.lit(0).cast("bigint"))  # no known value: 0


def normal_title(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def fingerprint() -> Column:
    """SHA-256 of the normal title and five moments (canonical, else raw); awareness is not part of it."""
    part = lambda m: F.coalesce(F.col(m), F.col(f"{m}_raw"), F.lit(""))
    return F.sha2(
        F.concat(
            F.lit("title="), normal_title(F.col("title")), F.lit("|start="), part("start_ts"), F.lit("|first_observed="), part("first_observed_ts"),
            F.lit("|ack="), part("ack_ts"), F.lit("|mitigate="), part("mitigate_ts"), F.lit("|resolve="), part("resolve_ts"),
        ),
        256,
    )


def percent(cell: Column, field: str) -> dict[str, Column]:
    """``value`` (0..100, else null) and ``warnings`` of a cell."""
    text = times.trimmed(cell)
    v = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    fits = v.between(0, 100)
    return {
        "value": F.when(fits, v),
        "warnings": compact(
            F.when(v.isNotNull() & ~fits, warning("VALIDATION_PCT_OUT_OF_RANGE", f"{field} out of range", F.concat(F.lit("value="), v.cast("string")))),
            F.when(text.isNotNull() & v.isNull(), warning("VALIDATION_PCT_PARSE_FAILED", f"Failed to parse {field}", F.concat(F.lit("value="), text))),
        ),
    }


CANONICAL_ORDER = ("coalesce(external_id, '')", "title", "id")


def canonical_order() -> list[Column]:
    return [F.expr(x) for x in CANONICAL_ORDER]

