"""The review as one deterministic Markdown document: small aggregated frames above a table and notes that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import incident as inc
from tidelog.functions import times
from tidelog.functions.warn import codes
from tidelog.operators import analytics as an
from tidelog.operators import tables
from tidelog.plans import dashboard
from tidelog.schema import METRICS

TITLE = "Quarterly Incident Review"
#: The rows of the metrics table.
LABELS = (
    "MTTD (start → first observed)", "IT awareness lag (observed → IT aware)", "MTTA (IT aware → ack)",
    "Time to mitigation (ack → mitigate)", "MTTR (start/observed → resolve)",
)


#: The headings.
HEADINGS = {
    "summary": "## Executive summary",
    "metrics": "## Metrics summary (distributions)",
    "severity": "## Severity distribution",
    "detection": "## Detection story",
    "mix": "### Detection source mix",
    "lag": "### IT awareness lag distribution",
    "reliability": "## Vendor/service reliability",
    "vendors": "### Top vendors by incident count",
    "services": "### Top services by incident count",
    "vendors_pain": "### Top vendors by weighted pain (impact × degradation × duration)",
    "services_pain": "### Top services by weighted pain (impact × degradation × duration)",
    "response": "## Response story",
    "mitigation": "### Time to mitigation distribution",
    "resolve": "### Time to resolve distribution",
    "incidents": "## Incidents (stable ordering)",
    "anomalies": "## Validation and anomalies appendix",
}


def duration(s: int | None) -> str:
    if s is None:
        return "UNKNOWN"
    m = s // 60
    return f"{m // 60}h {m % 60}m" if m >= 60 else f"{m}m {s % 60}s" if m else f"{s}s"


def rows(incidents: DataFrame) -> DataFrame:
    """The incident table of the report with warning codes; ``order_id``, ``title`` and ``id`` give its order."""
    m = an.with_warnings(inc.with_metrics(incidents))
    unknown = lambda c: F.coalesce(c, F.lit("UNKNOWN")).alias(c)
    return m.select(
        F.coalesce("external_id", F.lit("NO_EXTERNAL_ID")).alias("external_id"), "title", *[unknown(c) for c in ("severity", "detection_source", "vendor", "service")],
        times.duration_text(F.col("mttr_seconds")).alias("mttr"), "warning_count", codes(F.concat("metric_warnings", "validation_warnings")).alias("codes"),
        F.coalesce("external_id", F.lit("")).alias("order_id"), "id",
    )


def _items(frame: DataFrame, name: str = "label") -> list[str]:
    return [f"- {r[name]}: {r['count']}" for r in frame.select(name, "count").collect()]  # nine rows at most, or one for each severity


def _head(incidents: DataFrame, title: str) -> list[str]:
    """The report up to the incident table, from small aggregated frames."""
    m = dashboard.measured(incidents)
    f = dashboard.frames(incidents, with_ids=False)
    found = {r["metric"]: r for r in an.rank_percentiles(m, list(METRICS)).collect()}  # one row each; none without incidents
    points = [found.get(x) or {"known": 0, "total": 0, "p50": None, "p90": None} for x in METRICS]
    total = points[0]["total"]
    out = [f"# {title}", "", f"Incident count: **{total}**", "", HEADINGS["summary"], ""]
    out += ["- Made from the incident tables alone: equal tables give an equal text.", f"- Incidents counted: **{total}**", f"- Half of the resolved ones took no longer than **{duration(points[-1]['p50'])}** (P50 MTTR)", ""]
    out += [HEADINGS["metrics"], "", "| Metric | Known | P50 | P90 |", "|---|---:|---:|---:|"]
    out += [f"| {label} | {p['known']}/{total} | {duration(p['p50'])} | {duration(p['p90'])} |" for label, p in zip(LABELS, points, strict=True)]
    out += ["", HEADINGS["severity"], "", *_items(f["severity_counts"], "severity")]
    for above, name, frame in (("detection", "mix", "detection_source_mix"), (None, "lag", "it_awareness_lag_buckets"), ("reliability", "vendors", "top_vendors_by_count"), (None, "services", "top_services_by_count")):
        out += ["", *([HEADINGS[above], ""] if above else []), HEADINGS[name], "", *_items(f[frame])]
    for kind in ("vendors", "services"):
        out += ["", HEADINGS[f"{kind}_pain"], ""]
        out += [f"- {r['label']}: pain_sum={r['pain_sum']}, incidents={r['count']}, pain_known={r['pain_known_count']}" for r in f[f"top_{kind}_by_pain"].collect()]
    out += ["", HEADINGS["response"], "", HEADINGS["mitigation"], "", *_items(f["time_to_mitigation_buckets"]), "", HEADINGS["resolve"], "", *_items(f["time_to_resolve_buckets"])]
    out += ["", HEADINGS["incidents"], "", "In the order of `external_id` (none first), `title` and `id`.", ""]
    return [*out, "| External ID | Title | Severity | Detection | Vendor | Service | MTTR | Warnings |", "|---|---|---|---|---|---|---:|---:|"]


def lines(incidents: DataFrame, title: str = TITLE) -> DataFrame:
    """``line, text``: the report line by line, from 0.  Only the part above the incident table passes through the driver."""
    spark = incidents.sparkSession
    schema = "part int, external_id string, title string, id long, k int, text string"
    fixed = lambda part, texts: spark.createDataFrame([(part, "", "", 0, k, t) for k, t in enumerate(texts)], schema)
    listed = rows(incidents)
    shown = [c for c in listed.columns if c not in ("codes", "order_id", "id")]
    order = [F.col("order_id").alias("external_id"), "title", "id"]
    table = listed.select(F.lit(1).alias("part"), *order, F.lit(0).alias("k"), F.concat(F.lit("| "), F.array_join(F.array(*[F.col(c).cast("string") for c in shown]), " | "), F.lit(" |")).alias("text"))
    odd = listed.filter(F.size("codes") > 0)
    parts = F.array(F.concat(F.lit("### "), "external_id", F.lit(": "), "title"), F.lit(""), F.concat(F.lit("- Warning codes: "), F.array_join("codes", ", ")), F.lit(""))
    notes = odd.select(F.lit(3).alias("part"), *order, F.posexplode(parts).alias("k", "text"))
    between = fixed(2, ["", HEADINGS["anomalies"], ""])
    out = fixed(0, _head(incidents, title)).unionByName(table).unionByName(between).unionByName(fixed(3, ["- None."]) if odd.isEmpty() else notes)
    return tables.ranked(out, [F.col(c) for c in ("part", "external_id", "title", "id", "k")]).select((F.col("rn") - 1).alias("line"), "text")


def markdown(incidents: DataFrame, title: str = TITLE) -> str:
    return "\n".join(r["text"] for r in lines(incidents, title).orderBy("line").toLocalIterator()) + "\n"
