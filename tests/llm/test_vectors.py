"""Exact top-k search and hard negatives against every pair, in whole numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import hardneg, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, Query_ID string, vec string, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)


def whole(x, scale):
    """The vector in whole numbers, or None if it takes no part."""
    return None if x is None or any(c is None or not math.isfinite(c) for c in x) else [math.floor(scale * c) for c in x]


def dot(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


ODD = [
    (None, [1.0] * 6, 1), (500, None, 1), (501, [1.0, None, 0.0], 1), (502, [float("nan")] * 6, 2), (503, [float("inf")] + [0.0] * 5, 2),
    (600, [], 1), (700, [0.0] * 6, 2), (800, [0.5], 3), (900, [0.25] * 9, 3), (901, [3e9, -1.0], 0), (1000, [1e17, 1e12, 1.0], 1), (1001, [-1e17, 3.0], 2), (1002, [1e300, -2.0], 2),
]


def vecs(seed, n, dims=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dims)], r.choice([0, 1, 2, 3, None, -4])) for i in range(n)]
    base = [0.4] * dims
    for i in range(n, n + n // 3):  # a group of copies and near copies
        rows.append((i, base if i % 2 else [x + r.gauss(0, 0.001) for x in base], 1))
    return rows


def expected_topk(rows, scale, k, step):
    have = [(i, v) for i, x, _ in rows if i is not None and (v := whole(x, scale)) is not None]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in have if i % step == 0}):
        best = sorted((-dot(a, v), i) for i, v in have if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["mixed", "few", "copies", "lengths"])
def test_topk(spark, monkeypatch, case):
    rows = {"mixed": vecs(1, 300) + ODD, "few": ODD[:8], "copies": [(i % 90, [0.3, 0.1, -0.2], 0) for i in range(400)], "lengths": [(i, [x * (1 + i % 50) for x in v], 0) for i, v, _ in vecs(2, 600)]}[case]
    monkeypatch.setattr(topk, "RUN", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "SHORTER", 1)
    monkeypatch.setattr(topk, "SEEDS", 40)
    monkeypatch.setattr(topk, "PART_ROWS", 9)
    got = topk.search(frame(spark, rows), "vec_id", "embedding", F.col("id") % 20 == 0, scale=1024, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == expected_topk(rows, 1024, 10, 20)


def test_topk_by_coordinate_and_by_length(spark):
    """Both ways of pruning are taken, and each skips most of a cell."""
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(3000, 32))
    base = np.floor(1024 * base / np.linalg.norm(base, axis=1, keepdims=True))
    near = np.floor(base[:1] + r.normal(size=(60, 32)) * 10)
    all_ = np.concatenate((base, near))
    cell = topk.Cell(np.arange(len(all_)), all_, np.linalg.norm(all_, axis=1))
    query, norm = all_[0], float(np.linalg.norm(all_[0]))
    floor = np.int64(0.995 * norm * norm)
    assert len(listed := cell.listed(query, norm, floor, len(all_))) < 600
    assert {int(cell.ids[x]) for x in listed} >= {int(i) for i in np.flatnonzero(all_ @ query >= floor)}
    assert cell.listed(query, norm, np.int64(0.2 * norm * norm), len(all_)) is None
    long = topk.Cell(np.arange(1000), np.outer(np.arange(1000, 0, -1), np.ones(4)), 2.0 * np.arange(1000, 0, -1))
    found = long.best(np.array([-1]), np.ones((1, 4)), np.array([2.0]), np.array([3900]), 10)
    assert found.rows()[1].tolist() == list(range(10))


def test_topk_of_nothing(spark):
    assert topk.search(frame(spark, []), "vec_id", "embedding", F.col("id") % 100 == 0).collect() == []
    assert topk.search(frame(spark, [(1, [1.0], 0)]), "vec_id", "embedding", F.col("id") % 100 == 0).collect() == []
    assert vectors.packed(frame(spark, ODD), "vec_id", "embedding", 1024).count() == 8


def expected_negatives(rows, scale, step, n_positives=5, k=10, window=(30, 90)):
    have = [(i, y, tuple(v)) for i, x, y in rows if i is not None and y is not None and (v := whole(x, scale)) is not None]
    out = []
    for q, label, a in sorted({r for r in have if r[0] % step == 0}):
        scored = sorted((-dot(a, v), i, y) for i, y, v in have if i != q)
        for n, (s, p, _) in enumerate([r for r in scored if r[2] == label][:n_positives]):
            found = [(i, -t) for t, i, y in scored if y != label and window[0] * -s <= 100 * -t <= window[1] * -s][:k]
            out += [(q, p, r + 1, i, -s, t, n + 1) for r, (i, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("case", ["mixed", "few", "copies", "clusters", "one label", "negative"])
def test_hard_negatives(spark, monkeypatch, case):
    r = random.Random(5)
    clusters = [(i, [x + r.gauss(0, 0.05) for x in ([0.9, 0, 0, 0], [0, 0.9, 0, 0], [0.6, 0.6, 0, 0], [0, 0, 0.5, 0.8])[i % 4]], i % 3) for i in range(500)]
    rows = {
        "mixed": vecs(1, 300) + ODD, "few": ODD[:8], "copies": [(i % 90, [0.3, 0.1, -0.2], i % 2) for i in range(300)], "clusters": clusters,
        "one label": [(i, v, 4) for i, v, _ in vecs(4, 100)], "negative": [(i, [1.0 if i % 2 else -1.0, 0.1 * (i % 5)], i % 2 + (i % 20 == 0)) for i in range(80)],
    }[case]
    for name, value in (("BLOCK", 7), ("SLICE", 100), ("RUN", 16), ("STEP", 5), ("SEEDS", 60), ("PER_PIVOT", 3)):
        monkeypatch.setattr(hardneg, name, value)
    got = hardneg.mine(frame(spark, rows), "vec_id", "embedding", F.col("label"), F.col("id") % 20 == 0)
    expected = expected_negatives(rows, 256, 20)
    assert sorted(map(tuple, got.collect())) == expected
    assert expected or case in ("few", "one label", "copies", "negative")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(100, [1.0], 1)], [(1, [1.0], 1)], [(100, [1.0], None)]):
        assert hardneg.mine(frame(spark, rows), "vec_id", "embedding", F.col("label"), F.col("id") % 100 == 0).collect() == []


def test_groups_that_cannot_be_served_get_no_candidate():
    """Reach, plane and the windows' upper end each keep rows away, and never one that a group needs."""
    import numpy as np

    g = np.random.default_rng(2)
    centres = g.normal(size=(6, 12)) * 40
    rows = np.floor(np.repeat(centres, 200, axis=0) + g.normal(size=(1200, 12)) * 4)
    space = hardneg.Space(rows[::200], float(np.linalg.norm(rows, axis=1).max()))
    anchors = rows[::60]
    near, far, square = space.home(anchors)
    scores = vectors.products(anchors, rows)
    fifth = np.sort(scores, axis=1)[:, -6].astype(np.int64)
    radius = space.radius(square, fifth) + hardneg.EPS
    reach, most, inner = np.full(6, -1.0), np.full(6, -1.0), np.zeros(6)
    for p in range(6):
        reach[p], most[p] = (far + radius)[near == p].max(initial=-1), radius[near == p].max(initial=-1)
    every = lambda x: np.broadcast_to(x, (len(rows), 6))
    served = space.served(rows, every(reach), every(most), every(inner))
    assert served.mean() < 0.5
    assert all(served[s, near[a]] for a, s in zip(*np.nonzero(scores >= fifth[:, None]), strict=True))
    assert not space.served(rows, every(reach), every(most), every(np.full(6, 3.0))).any()


def test_share_of_scores():
    import numpy as np

    for pct in (30, 90):
        x = np.array([-(10**18), -101, -1, 0, 1, 7, 99, 10**18 + 3])
        assert hardneg.share(pct, x, False).tolist() == [pct * int(v) // 100 for v in x]
        assert hardneg.share(pct, x, True).tolist() == [-(-pct * int(v) // 100) for v in x]
