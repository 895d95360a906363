"""Connected components by alternating large-star and small-star steps.

Each round is two distributed aggregations with map-side combining; links stay
in the cluster, and each round's links are written to the shared folder, so
lineage stays short and lost executors repeat at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels


def _large_star(e: DataFrame) -> DataFrame:
    """e: (a, b), b < a.  Every node hands its larger neighbours to the least of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: ``a, b`` (longs) -> ``node, root`` for every node that has an edge."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    last = None
    for _ in range(max_rounds):
        nxt = kernels.cut(_small_star(_large_star(e)))
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last is not None:
            kernels.drop_cut(e)
        e = nxt
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
