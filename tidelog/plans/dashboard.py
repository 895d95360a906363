"""The dashboard: small reconciling frames, and one nested document assembled from them on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import incident as inc
from tidelog.operators import analytics as an
from tidelog.operators import membership as ms


def measured(incidents: DataFrame) -> DataFrame:
    return an.with_pain(inc.with_metrics(incidents))


def frames(incidents: DataFrame, with_ids: bool = True) -> dict[str, DataFrame]:
    """Every data set of the dashboard, each reconciling to the incident total.

    with_ids: an array of ids in every row, as the document has it; without, the frames stay small however many incidents there are.
    """
    m = measured(incidents)
    return {
        "severity_counts": an.severity_counts(m, with_ids),
        "detection_source_mix": an.category_mix(m, "detection_source", with_ids),
        "it_awareness_lag_buckets": an.duration_histogram(m, "it_awareness_lag_seconds", "it_awareness_lag", with_ids),
        "time_to_mitigation_buckets": an.duration_histogram(m, "time_to_mitigation_seconds", "time_to_mitigation", with_ids),
        "time_to_resolve_buckets": an.duration_histogram(m, "mttr_seconds", "time_to_resolve", with_ids),
        "top_vendors_by_count": an.top_by_count(m, "vendor", with_ids=with_ids),
        "top_services_by_count": an.top_by_count(m, "service", with_ids=with_ids),
        "top_vendors_by_pain": an.top_by_pain(m, "vendor", with_ids=with_ids),
        "top_services_by_pain": an.top_by_pain(m, "service", with_ids=with_ids),
    }


def members(incidents: DataFrame) -> dict[str, DataFrame]:
    """The same data sets with bitmaps of their members, for sets of incidents of any size (``operators.membership``)."""
    m = measured(incidents)
    return {
        "severity_counts": ms.severity(m),
        "detection_source_mix": ms.mix(m, "detection_source"),
        "it_awareness_lag_buckets": ms.histogram(m, "it_awareness_lag_seconds", "it_awareness_lag"),
        "time_to_mitigation_buckets": ms.histogram(m, "time_to_mitigation_seconds", "time_to_mitigation"),
        "time_to_resolve_buckets": ms.histogram(m, "mttr_seconds", "time_to_resolve"),
        "top_vendors_by_count": ms.top_by_count(m, "vendor"),
        "top_services_by_count": ms.top_by_count(m, "service"),
        "top_vendors_by_pain": ms.top_by_pain(m, "vendor"),
        "top_services_by_pain": ms.top_by_pain(m, "service"),
    }


def payload(incidents: DataFrame, version: int = 2) -> dict:
    """The document; its parts are bounded but for incident lists, so it is for review-sized sets."""
    kept = incidents.persist()
    try:
        rows = lambda f: [json.loads(x) for x in f.toJSON().collect()]
        f = frames(kept)
        out = {"version": version, "incident_count": kept.count(), "severity_counts": rows(f["severity_counts"]), "incidents": rows(an.summaries(kept, version))}
        if version == 2:
            out["detection_story"] = {k: rows(f[k]) for k in ("detection_source_mix", "it_awareness_lag_buckets")}
            out["vendor_service_story"] = {k: rows(f[k]) for k in ("top_vendors_by_count", "top_services_by_count", "top_vendors_by_pain", "top_services_by_pain")}
            out["response_story"] = {k: rows(f[k]) for k in ("time_to_mitigation_buckets", "time_to_resolve_buckets")}
        return out
    finally:
        kept.unpersist()


class Cache:
    """Payloads for a time, by what stands for the incidents' contents and by version; the clock is an argument.

    A workspace gives a key for each version of a table; without one the contents are hashed in Spark, whatever their order.
    """

    def __init__(self, ttl_seconds: float = 300):
        self.ttl, self.kept = ttl_seconds, {}
        self.hits = self.misses = 0

    def get(self, incidents: DataFrame, version: int, now: float, key: str | None = None) -> dict:
        key = key or an.content_hash(incidents).first()["content_hash"]
        held = self.kept.get(version)
        if held and held[0] == key and now - held[1] < self.ttl:
            self.hits += 1
            return held[2]
        self.misses += 1
        out = payload(incidents, version)
        self.kept[version] = (key, now, out)
        return out

    def invalidate(self, version: int | None = None) -> None:
        self.kept = {} if version is None else {k: v for k, v in self.kept.items() if k != version}

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.kept), "hits": self.hits, "misses": self.misses}


def gate(states: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """states plus ``blocked_by``: the first check (name, SQL condition that must hold) that fails."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(~F.coalesce(F.expr(holds), F.lit(False)), name).otherwise(out)
    return states.withColumn("blocked_by", out)
