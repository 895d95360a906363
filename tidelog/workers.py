"""Puts this package within reach of Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def reach(spark: SparkSession) -> SparkSession:
    """By path where the workers share the driver's disk, else as a file that Spark sends them once."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        env = context.environment
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH", "")) if x)
    elif context.applicationId not in _SENT:
        packed = Path(tempfile.mkdtemp()) / "tidelog.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.glob("tidelog/**/*.py")):
                z.write(f, f.relative_to(root))
        context.addPyFile(str(packed))
        _SENT.add(context.applicationId)
    return spark
