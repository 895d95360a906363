"""A fixed demonstration set of 40 incidents, from modular patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import incident as inc
from tidelog.schema import INCIDENT, MOMENTS, RAW

#: Fixed values.
SEVERITIES = ("SEV0", "SEV1", "SEV2", "SEV3")
IMPACTS = (80, 50, 25, 10)
DETECTIONS = ("monitoring", "customer", "vendor", "internal_test")
VENDORS = ("AcmeCloud", "ContosoNet", "ExampleVendor", "WidgetCo")
SERVICES = ("payments", "auth", "api", "search", "billing")
MINUTES = (0, 5, 10, 15, 45, 55)


def incidents(spark: SparkSession, n: int = 40) -> DataFrame:
    i = F.col("id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), ((i - 1) % len(xs) + 1).cast("int"))
    impact = pick(IMPACTS).cast("long")
    day, hour = F.floor((i - 1) / 2) + 1, (i - 1) % 2 * 6

    def moment(minute: int) -> Column:
        return F.format_string("2026-01-%02dT%02d:%02d:00Z", day, hour, F.lit(minute))

    rows = spark.range(1, n + 1).select(
        "id", F.format_string("IR-%03d", i).alias("external_id"), F.concat(F.lit("Demo incident "), i.cast("string")).alias("title"),
        F.lit(None).cast("string").alias("description"), pick(SEVERITIES).alias("severity"), pick(DETECTIONS).alias("detection_source"),
        pick(VENDORS).alias("vendor"), pick(SERVICES).alias("service"), impact.alias("impact_pct"), (F.lit(100) - F.floor(impact / 2)).alias("service_health_pct"),
        *[moment(x).alias(m) for m, x in zip(MOMENTS, MINUTES, strict=True)], *[F.lit(None).cast("string").alias(r) for r in RAW],
    )
    return rows.withColumn("fingerprint", inc.fingerprint()).select(*INCIDENT.fieldNames())
