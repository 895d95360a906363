"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and evaluates every rule once: a row holds
the measurements and one long, ``failed_bits``, with a bit for each rule that
failed.  ``apply_policy`` turns bits into a verdict with one AND, so a new policy
version reads the ledger and no text.  ``ablation`` counts, for each rule of a
policy, the rows that fail it alone and the rows lost without it, by AND, OR and
bit counts in one aggregation.

Defined cases: null and wordless texts have all-zero measurements and fail
``few_words``; repeated rows are measured each; an empty table gives an empty
ledger, whose ablation has one row of zeros per rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

WINDOW = 8
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_upper": "long", "n_marks": "long", "n_letters": "long", "n_stutters": "long",
}

#: Bit number -> (name, SQL condition under which the rule fails).
RULES: dict[int, tuple[str, str]] = {
    0: ("few_words", "n_words < 20"),
    1: ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    2: ("symbols", "10 * n_symbols > n_words"),
    3: ("shouting", "2 * n_upper > n_letters"),
    4: ("marks", "5 * n_marks > n_words"),
    5: ("duplicate_lines", "n_lines > 0 and 2 * n_dup_lines > n_lines"),
    6: ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    7: ("many_words", "n_words > 1000000"),
    8: ("few_letters", "n_words > 0 and 10 * n_letters < 5 * word_chars"),
    9: ("stutter", "10 * n_stutters > 3 * n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        number = {name: bit for bit, (name, _) in RULES.items()}
        return sum(1 << number[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("v1", tuple(name for name, _ in RULES.values()))


_NOT_ASCII = re.compile("[^\x00-\x7f]+")


def _other_letters(texts: list[bytes], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters beyond ASCII in each text."""
    out = np.zeros(len(texts), dtype=np.int64)
    high = np.diff(np.concatenate(([0], np.cumsum(data >= 0x80)))[at])
    for i in np.flatnonzero(high).tolist():
        out[i] = sum(map(str.isalpha, "".join(_NOT_ASCII.findall(texts[i].decode("utf-8", "replace")))))
    return out


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = kernels.Words(texts)
    data = w.data
    body = ~w.space
    at = w.offsets
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    out = {"n_words": w.counts}
    out["word_chars"] = total(body & ((data & 0xC0) != 0x80))
    out["n_symbols"] = total(_SYMBOL[data])
    out["n_upper"] = total((data >= 65) & (data <= 90))
    out["n_letters"] = total(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 0x80)) + _other_letters(texts, data, at)
    out["n_marks"] = total((data == 33) | (data == 63))

    # lines with a word, and those equal to an earlier one of the same text
    stop = np.union1d(np.flatnonzero(data == 10), at[1:] - 1)
    begin = np.concatenate(([0], stop[:-1] + 1))
    words_before = np.concatenate(([0], np.cumsum(body)))
    full = words_before[stop] > words_before[begin]
    begin, stop = begin[full], stop[full]
    text = np.searchsorted(at, begin, "right") - 1
    key = kernels.finish(kernels.span_hashes(data, begin, stop) + text.astype(np.uint64) * kernels._MUL)
    order = np.lexsort((begin, key))
    again = np.zeros(len(key), dtype=np.int64)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    n = len(texts)
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = np.bincount(text, weights=again, minlength=n).astype(np.int64)

    # words equal to the word before them in the text
    word = w.hashes()
    same = np.zeros(len(word), dtype=np.int64)
    same[1:] = word[1:] == word[:-1]
    same[w.first[:-1][w.counts > 0]] = 0
    out["n_stutters"] = kernels.per_text(same, w.first)

    # words inside windows found twice or more in the text
    h = kernels.window_hashes(word, WINDOW)
    covered = np.zeros(len(w.start) + 1, dtype=np.int64)
    if len(h):
        t = w.texts_of_words()
        inside = np.flatnonzero(t[: len(h)] == t[WINDOW - 1 :])
        key = kernels.finish(h[inside] + t[inside].astype(np.uint64) * kernels._MUL)
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        hit = inside[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    out["n_repeat_words"] = kernels.per_text(np.cumsum(covered)[:-1] > 0, w.first)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, every measurement and ``failed_bits``, one row for each row of docs."""
    kernels.session(docs)
    names = list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            m = _measure(kernels.raw(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[k].astype(np.int64)) for k in names]], names=["id", *names])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = src.mapInArrow(run, "id long, " + ", ".join(f"{k} {t}" for k, t in MEASURES.items()))
    bits = F.lit(0).cast("long")
    for bit, (_, fails) in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def apply_policy(led: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds ``policy_version`` and ``kept``."""
    return led.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", F.col("failed_bits").bitwiseAND(policy.mask) == 0)


def ablation(led: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of the policy: rows failing it, failing only it, and kept if it were left out."""
    hit = F.col("failed_bits").bitwiseAND(policy.mask)
    number = {name: bit for bit, (name, _) in RULES.items()}
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = [F.struct(F.lit(r).alias("rule"), count(hit.bitwiseAND(1 << number[r]) != 0).alias("n_failed"), count(hit == (1 << number[r])).alias("n_only"), count(hit.bitwiseAND(policy.mask & ~(1 << number[r])) == 0).alias("n_kept_without")) for r in policy.rules]
    return led.agg(F.array(*sums).alias("x")).select(F.lit(policy.version).alias("policy_version"), F.inline("x"))
