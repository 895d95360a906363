"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, i long, len string, Block int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(parts)


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    node = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = own.get(base, [])[:h] + mine[h:]
        for d in range(len(seq) + 1):
            node.setdefault(tuple(seq[:d]), [[], []])[0].append(c)
        node[tuple(seq)][1].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in node:
        if p:
            kids[p[:-1]] += 1
    for p, (members, _) in node.items():
        own_saved = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += not kids[p]
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted((min(m), len(p), min(node[p[:-1]][0]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(e)) for p, (m, e) in node.items())


def built(spark, rows):
    got = trie.nodes(*trie.grafted(trie.turns(frame(spark, rows)), every=20, spread=4))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect())


def random_rows(seed, n, alphabet, longest):
    r = random.Random(seed)
    rows = []
    for c in range(-30, n):
        if r.random() < 0.9:
            rows += [(c, t, r.choice(["user", None]), r.choice(["a", "b c", "", None, "d e f"][:alphabet])) for t in range(r.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("case", ["dense", "deep", "one line", "copies", "odd", "unlike"])
def test_trie(spark, monkeypatch, case):
    rows = {
        "dense": random_rows(1, 120, 2, 6), "deep": random_rows(2, 60, 1, 40), "unlike": [(c, t, "user", f"{c} {t}") for c in range(50) for t in range(1 + c % 5)],
        "one line": [(c, t, "user", "same") for c in range(90) for t in range(c + 1)], "copies": [(c, t, "u", f"t{t}" if c % 3 else f"{c % 7}") for c in range(150) for t in range(5)],
        "odd": [(None, 1, "user", "x"), (5, None, None, None), (5, None, "a", "z"), (5, 1, "user", "long " * 50_000), (5, 1, "user", "long " * 50_000), (7, 2, "ab", "c"), (8, 2, "a", "bc"), (2**40, 0, "user", "中文 x"), *[(9, t, "u", str(t)) for t in range(700)]],
    }[case]
    monkeypatch.setattr(trie, "BLOCK", {"deep": 3, "one line": 5, "odd": 1}.get(case, 16))
    assert built(spark, rows) == expected(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "a", "b")]) == []
    assert built(spark, [(20, 1, "a", "b c")]) == expected([(20, 1, "a", "b c")])


def test_running_sums_across_partitions(spark):
    """A key over several partitions, keys that end with one, sums that wrap."""
    rows = [(k, i, 2**62 if k == 3 else 1) for k, n in ((1, 5), (2, 1), (3, 400), (4, 1), (5, 90)) for i in range(n)]
    frame_ = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    for parts in (1, 7, 40):
        got = trie.running(frame_.repartitionByRange(parts, "k", "i").sortWithinPartitions("k", "i"), "k", ["v"]).collect()
        assert len(got) == len(rows)
        for r in got:
            want = (2**62 * (r.i + 1) + 2**63) % 2**64 - 2**63 if r.k == 3 else r.i + 1
            assert r.v == want


def test_long_conversation_has_a_short_key(spark):
    rows = [(1, t, "u", f"t{t}") for t in range(3000)] + [(4, 0, "u", "t0"), (4, 1, "u", "else")]
    found = trie.turns(frame(spark, rows)).withColumnRenamed("pos", "depth")
    keys = {r.conv_id: len(r.key) for r in trie._sorted(found, found.groupBy("conv_id").agg(F.max("depth").alias("len"))).collect()}
    assert keys == {1: 1, 4: 1}
