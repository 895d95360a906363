"""Upsert of staged issue rows into the incident table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.functions import incident as inc
from tidelog.functions import times
from tidelog.operators import tables
from tidelog.schema import INCIDENT, MOMENTS, PERCENTS, RAW, TEXTS


@dataclass
class ImportResult:
    incidents: DataFrame  # the new version of the table
    outcomes: DataFrame  # row, outcome (inserted / updated / skipped), reason, external_id, fingerprint
    warnings: DataFrame  # row, code, message, details
    changes: DataFrame  # the rows of the new version that changed or came

    def summary(self) -> dict[str, int]:
        n = {r["outcome"]: r["n"] for r in self.outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"inserted": n.get("inserted", 0), "updated": n.get("updated", 0), "skipped": n.get("skipped", 0), "conflicts": self.outcomes.filter("reason is not null").count(), "warnings": self.warnings.count()}


#: Why a row is left out.
REPEATED_ID, REPEATED_FINGERPRINT = "An earlier row has this external_id", "An earlier row has this fingerprint"
CONFLICT_ON_INSERT, CONFLICT_ON_UPDATE = "Another incident holds the new row's fingerprint", "Another incident holds the updated fingerprint"
COMPARED = [*TEXTS, "fingerprint", *PERCENTS, *MOMENTS, *RAW]


def first_rows(staged: DataFrame) -> DataFrame:
    """staged plus ``reason``: null for rows that go on; repeats of an id, then of a fingerprint, lose to the first."""
    usable = ~F.col("bad") & F.col("title").isNotNull()
    by_id = Window.partitionBy("external_id", usable).orderBy("row")
    a = staged.withColumn("__a", usable & F.col("external_id").isNotNull() & (F.row_number().over(by_id) > 1))
    still = usable & ~F.col("__a")
    by_fp = Window.partitionBy("fingerprint", still).orderBy("row")
    b = a.withColumn("__b", still & (F.row_number().over(by_fp) > 1))
    reason = F.when(F.col("__a"), REPEATED_ID).when(F.col("__b"), REPEATED_FINGERPRINT)
    return b.withColumns({"reason": reason, "usable": usable}).drop("__a", "__b")


def combined(matched: DataFrame) -> DataFrame:
    """Rows with the stored incident they match (``old_...``, null for none), merged without losing stored values, and what that makes of them."""
    new: dict[str, Column] = {}
    for c in (*TEXTS[2:], *PERCENTS, "external_id"):
        new[c] = F.coalesce(c, f"old_{c}")
    for m in MOMENTS:
        given = F.col(f"{m}_given")
        new[m] = F.when(given, F.col(m)).otherwise(F.col(f"old_{m}"))
        new[f"{m}_raw"] = F.when(given, F.col(f"{m}_raw")).otherwise(F.col(f"old_{m}_raw"))
    merged = times.once(times.once(matched.withColumns(new)).withColumn("fingerprint", inc.fingerprint()))
    same = F.struct(*COMPARED).eqNullSafe(F.struct(*[F.col(f"old_{c}").alias(c) for c in COMPARED]))
    return times.once(merged.withColumn("outcome", F.when(F.col("inc").isNull(), "inserted").when(same, "skipped").otherwise("updated")))


# Rows take effect one after the other: an earlier row can take a fingerprint, or leave one that a later row then finds free, and it can
# change the incident that a later row merges with.  Each row's result depends on earlier rows only.  So all rows are first tried against
# the stored table; then, round by round, those rows are tried anew that would now see another holder of a fingerprint or another
# version of their incident than they did.  When no row would, every row has seen what the rows before it left.

_OLD = [f"old_{c}" for c in INCIDENT.fieldNames()]
_SEEN = ("saw_holder", "saw_version", "saw_claim")


def _stored_key() -> Column:
    return F.concat(F.lit("s"), F.col("id").cast("string"))


def _changes(state: DataFrame) -> DataFrame:
    """``kind, key, at, holder``: who holds a fingerprint (f) from a row on, null for nobody, and which incidents (i) a row gave a new version."""
    done = state.filter("outcome IN ('inserted', 'updated')")
    change = lambda kind, key, holder: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), holder.alias("holder"))
    none = F.lit(None).cast("string")
    moved = F.coalesce(F.col("old_fingerprint") != F.col("fingerprint"), F.lit(True))
    listed = F.array(
        change("i", "inc", none), F.when(moved, change("f", "fingerprint", F.col("inc"))), F.when(moved & F.col("old_fingerprint").isNotNull(), change("f", "old_fingerprint", none)),
    )
    return done.select(F.col("row").alias("at"), F.explode(F.array_compact(listed)).alias("c")).select("c.kind", "c.key", "at", "c.holder")


def _latest(asked: DataFrame, changes: DataFrame, *keep: str) -> DataFrame:
    """``row, <keep>, at, holder``: of each asked key the last change before the row; keys without one are absent."""
    met = asked.join(changes, ["kind", "key"]).filter("at < row")
    return met.groupBy("row", *keep).agg(F.max_by(F.struct("at", "holder"), "at").alias("c")).select("row", *keep, "c.at", "c.holder")


def _asked(rows: DataFrame, kind: str, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).select("row", F.lit(kind).alias("kind"), F.col(key).alias("key"))


def _tried(rows: DataFrame, incidents: DataFrame, changes: DataFrame, state: DataFrame | None) -> DataFrame:
    """Each row with its match, its merged values and its outcome, after the stored table and the changes before it."""
    stored = incidents.select(_stored_key().alias("stored"), "external_id", "fingerprint")
    by_id = rows.filter("external_id is not null").join(stored.select(F.col("stored").alias("inc"), "external_id"), "external_id", "left")
    none = F.lit(None).cast("string")
    by_id = by_id.withColumn("saw_holder", none)
    # the holder of the row's own fingerprint, by what the batch did to it, else by what is stored
    blank = rows.filter("external_id is null").withColumn("given", F.col("fingerprint"))
    now = _latest(_asked(blank, "f", "given"), changes).select("row", F.struct(F.col("at").cast("string").alias("at"), "holder").alias("now"))
    by_print = blank.drop("given").join(now, "row", "left").join(stored.select("stored", "fingerprint"), "fingerprint", "left")
    saw = F.concat_ws(":", "now.at", "now.holder")
    by_print = by_print.withColumns({"inc": F.when(F.col("now").isNotNull(), F.col("now.holder")).otherwise(F.col("stored")), "saw_holder": F.when(F.col("now").isNotNull(), saw)}).drop("now", "stored")
    found = times.once(by_id.unionByName(by_print))
    # the incident's version
    version = _latest(_asked(found, "i", "inc"), changes).select("row", F.col("at").alias("version"))
    found = found.join(version, "row", "left").withColumn("saw_version", F.col("version").cast("string"))
    base = incidents.select(_stored_key().alias("inc"), *[F.col(c).alias(f"old_{c}") for c in INCIDENT.fieldNames()])
    matched = found.filter("version is null").join(base, "inc", "left").drop("version")
    if state is not None:
        newer = state.select(F.col("row").alias("version"), F.col("old_id"), *[F.col(c).alias(f"old_{c}") for c in INCIDENT.fieldNames() if c != "id"])
        matched = matched.unionByName(found.filter("version is not null").join(newer, "version").drop("version"))
    done = combined(matched)
    done = done.withColumn("inc", F.when(F.col("outcome") == "inserted", F.concat(F.lit("r"), F.col("row").cast("string"))).otherwise(F.col("inc")))
    # uniqueness: the fingerprint that the row leads to may have another holder just then
    claim = done.filter("outcome <> 'skipped'")
    now = _latest(_asked(claim, "f", "fingerprint"), changes).select("row", F.struct(F.col("at").cast("string").alias("at"), "holder").alias("now"))
    held = stored.select(F.col("stored").alias("held"), "fingerprint")
    done = done.join(now, "row", "left").join(held, "fingerprint", "left")
    done = done.withColumns({"held": F.when(F.col("now").isNotNull(), F.col("now.holder")).otherwise(F.col("held")), "saw_claim": F.when(F.col("now").isNotNull(), saw)})
    clash = (F.col("outcome") != "skipped") & F.col("held").isNotNull() & (F.col("held") != F.col("inc"))
    late = F.when(clash, F.when(F.col("outcome") == "inserted", CONFLICT_ON_INSERT).otherwise(CONFLICT_ON_UPDATE))
    return done.withColumns({"reason": late, "outcome": F.when(clash, "skipped").otherwise(F.col("outcome"))}).select(*_kept())


def _kept() -> list[str]:
    return ["row", "inc", "outcome", "reason", *_SEEN, *_OLD, *[c for c in INCIDENT.fieldNames() if c != "id"]]


def _stale(rows: DataFrame, state: DataFrame, changes: DataFrame) -> DataFrame:
    """``row``: rows that would now see something else than they did."""
    own = rows.filter("external_id is null").select("row", "fingerprint")
    # a row that lost its fingerprint to another still asks for the same one
    parts = {"saw_holder": _asked(own, "f", "fingerprint"), "saw_version": _asked(state, "i", "inc"), "saw_claim": _asked(state.filter("outcome <> 'skipped' OR reason IS NOT NULL"), "f", "fingerprint")}
    asked = None
    for name, part in parts.items():
        part = part.withColumn("what", F.lit(name))
        asked = part if asked is None else asked.unionByName(part)
    now = _latest(asked, changes, "what").withColumn("seen", F.when(F.col("what") == "saw_version", F.col("at").cast("string")).otherwise(F.concat_ws(":", F.col("at").cast("string"), "holder")))
    now = now.groupBy("row").agg(*[F.max(F.when(F.col("what") == n, F.col("seen"))).alias(f"now_{n}") for n in _SEEN])
    before = state.select("row", *_SEEN).filter(" OR ".join(f"{n} IS NOT NULL" for n in _SEEN))
    both = before.join(now, "row", "full")
    equal = F.lit(True)
    for n in _SEEN:
        equal = equal & F.col(n).eqNullSafe(F.col(f"now_{n}"))
    return both.filter(~equal).select("row")


def settle(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """What becomes of each row when rows take effect in order: ``row, inc, outcome, reason`` with the merged values.

    As many rounds as the longest chain of rows of which each depends on the one before; without such rows it is one, and one join that tells so.
    """
    empty = rows.sparkSession.createDataFrame([], "kind string, key string, at long, holder string")
    state = durable.written(_tried(rows, incidents, empty, None))
    while True:
        changes = _changes(state)
        stale = durable.written(_stale(rows, state, changes))
        if stale.isEmpty():
            return state
        changes = durable.written(changes)
        again = _tried(rows.join(stale, "row", "left_semi"), incidents, changes, state)
        state = durable.written(state.join(stale, "row", "left_anti").unionByName(again))


def upsert(staged: DataFrame, incidents: DataFrame) -> ImportResult:
    # what both results and warnings come from is written once
    ranked = durable.written(first_rows(staged))
    settled = settle(ranked.filter("usable and reason is null"), incidents)
    names = INCIDENT.fieldNames()
    # the last version of each incident that changed or came
    last = Window.partitionBy("inc").orderBy(F.desc("row"))
    final = settled.filter("outcome IN ('inserted', 'updated')").withColumns({"__n": F.row_number().over(last), "came": F.min(F.when(F.col("outcome") == "inserted", F.col("row"))).over(Window.partitionBy("inc"))}).filter("__n = 1")
    changed = final.filter("came is null").withColumn("id", F.col("old_id"))
    added = tables.next_ids(final.filter("came is not null"), incidents, [F.col("came")])
    kept = incidents.join(changed.select("id"), "id", "left_anti")
    changes = changed.select(*names).unionByName(added.select(*names))
    table = kept.select(*names).unionByName(changes)
    lost = ranked.filter("not usable or reason is not null").select("row", F.lit("skipped").alias("outcome"), "reason", "external_id", "fingerprint")
    outcomes = settled.select("row", "outcome", "reason", "external_id", "fingerprint").unionByName(lost)
    # a row that repeats an id is dropped before its cells are read
    seen = ranked.filter(F.col("reason").isNull() | (F.col("reason") != REPEATED_ID))
    warnings = seen.select("row", F.posexplode("row_warnings").alias("pos", "w")).orderBy("row", "pos").select("row", "w.*")
    return ImportResult(table, outcomes, warnings, changes)
