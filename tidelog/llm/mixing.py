"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a domain - language - source tree.  At each node it is
shared among the children by integer weights; a child that cannot use its share
(its subtree has too few tokens, counting ``max_epochs`` passes) is filled and what it
leaves goes to its siblings; only what a whole subtree cannot use reaches the
siblings of an ancestor, because every subtree's capacity bounds its share above.

A leaf's budget buys whole seeded epochs first, then a token-prefix of the next
one: documents in the order of a hash of seed, epoch and id, as long as the running
token count stays within what is left.  The running count takes two steps (sums
of hash-ordered buckets, then inside the one bucket where the prefix ends), so a leaf
with a third of all rows is never in one task.

All numbers are integers, so the result does not depend on the order of additions.
Defined cases: null domain, language or source is the child ``?``; null and wordless
texts have no tokens and are in every epoch prefix they precede; rows without an id are ordered by their texts; repeated rows count and
are chosen each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import kernels

WORD = r"[^\x20\x09-\x0D]+"
#: Hash-ordered buckets hold about this many documents.
BUCKET_ROWS = 4096
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Integer weights by child name at each level (a child without one has ``default``), and the budget.

    ``budget_pct``: the token budget in hundredths of all tokens.  ``domain_sql``: a row's domain.
    """

    domain: Mapping[str, int] = field(default_factory=dict)
    lang: Mapping[str, int] = field(default_factory=dict)
    source: Mapping[str, int] = field(default_factory=dict)
    default: int = 10
    budget_pct: int = 80
    max_epochs: int = 4
    seed: int = 42
    domain_sql: str = "concat('d', try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) div 5)"

    def weight(self, level: str, name: Column) -> Column:
        out = F.lit(self.default)
        for k, v in sorted(getattr(self, level).items()):
            out = F.when(name == k, F.lit(v)).otherwise(out)
        return out.cast("long")


def tokens(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes: parent columns, ``name, weight, cap, budget`` (the parent's) -> plus ``alloc``.

    Children in the order of cap / weight fill up one after the other; the first that does not, and
    all behind it, share the rest by weight, rounded down.
    """
    order = [F.col("cap") / F.col("weight"), F.col("name")]
    w = Window.partitionBy(*parent).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = w.rowsBetween(0, Window.unboundedFollowing)
    x = nodes.withColumns({"left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("weight").over(behind)})
    x = x.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("weight") * F.col("left"))
    first = F.min(F.when(~F.col("full"), F.struct(order[0].alias("o"), "name", "left", "w_left"))).over(Window.partitionBy(*parent))
    x = x.withColumn("stop", first)
    return x.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("stop.left * weight div stop.w_left"))).drop("left", "w_left", "full", "stop")


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """leaves: ``domain, lang, source, leaf_tokens, n`` -> plus ``alloc``, each leaf's token budget."""
    caps = leaves.withColumn("cap", F.col("leaf_tokens") * targets.max_epochs)
    total = caps.agg(F.least(F.floor(F.coalesce(F.sum("leaf_tokens"), F.lit(0)) * targets.budget_pct / 100), F.coalesce(F.sum("cap"), F.lit(0))).cast("long").alias("budget"))
    level = total
    for i, name in enumerate(LEVELS):
        parent = list(LEVELS[:i])
        nodes = caps.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(level, parent) if parent else nodes.crossJoin(F.broadcast(level))  # one row
        nodes = nodes.withColumns({"name": F.col(name), "weight": targets.weight(name, F.col(name))})
        level = share(nodes, parent).select(*LEVELS[: i + 1], F.col("alloc").alias("budget"))
    return leaves.join(level.withColumnRenamed("budget", "alloc"), list(LEVELS))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def _leaf_columns(docs: DataFrame, targets: Targets) -> dict[str, Column]:
    return {
        "domain": F.coalesce(F.expr(targets.domain_sql).cast("string"), F.lit("?")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("?")),
        "source": F.coalesce(F.col("source").cast("string"), F.lit("?")),
    }


def _tie(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def mix(docs: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document chosen at least once: ``id, domain, lang, source, n_tokens, copies, whole_epochs``."""
    return _chosen(docs, targets, id_col, text_col).drop("tie")


def _chosen(docs: DataFrame, targets: Targets, id_col: str, text_col: str) -> DataFrame:
    """As ``mix``, with ``tie``, a hash of the text that tells rows of one id apart."""
    # rows without an id are spread by their texts
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), _tie(text_col).alias("tie"), tokens(text_col).alias("n_tokens"), *[c.alias(k) for k, c in _leaf_columns(docs, targets).items()])
    rows = kernels.cut(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("n"))
    plan = kernels.cut(budgets(leaves, targets))
    plan = plan.withColumn("whole_epochs", F.expr("coalesce(try_divide(alloc - alloc % nullif(leaf_tokens, 0), leaf_tokens), 0)").cast("long"))
    plan = plan.withColumn("rest", F.col("alloc") - F.col("whole_epochs") * F.col("leaf_tokens"))
    # a power of two so that a bucket is a range of the order
    plan = plan.withColumn("shift", F.lit(60) - F.ceil(F.log2(F.greatest(F.col("n") / BUCKET_ROWS, F.lit(1)))).cast("int"))
    on = list(LEVELS)
    ranked = rows.join(plan.select(*on, "whole_epochs", "rest", "shift"), on)
    ranked = ranked.withColumn("h", _order(targets.seed, F.col("whole_epochs") + 1, F.col("key"))).withColumn("bucket", F.expr("shiftright(h, shift)"))
    sums = ranked.groupBy(*on, "bucket").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy(*on).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0))).drop("t")
    inside = Window.partitionBy(*on, "bucket").orderBy("h", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranked.join(starts, [*on, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    copies = F.col("whole_epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("long")).filter("copies > 0").select("id", *on, "n_tokens", "copies", "whole_epochs", "tie")


def mixed_documents(docs: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows, each as often as it was chosen.  Rows that share id and text are chosen as often as the most-chosen of them."""
    chosen = _chosen(docs, targets, id_col, text_col).groupBy("id", "tie").agg(F.max("copies").cast("int").alias("copies"))
    # rows travel as one struct, so their columns cannot meet the working ones
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"), _tie(text_col).alias("row_tie"))
    joined = rows.join(chosen, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_tie") == F.col("tie")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
