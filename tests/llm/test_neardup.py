"""Near duplicates against a comparison of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidelog.llm import neardup


def shingle_set(text, k=5):
    w = (text or "").encode().lower().decode().encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_similar(texts, similarity=0.8):
    """The least index that each text reaches by pairs that share enough of their shingles."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or (x and len(x & sets[j]) >= similarity * len(x | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def edited(text, places, word="edit"):
    w = text.split()
    for p in places:
        w[p] = f"{word}{p}"
    return " ".join(w)


def groups_of(frame):
    return {r["id"]: r["component_id"] for r in neardup.similar_groups(frame).collect()}


def test_similar_groups(docs, words):
    texts = [*ODD]
    for s in range(12):
        base = words(s, 240)
        # shingle similarities 0.96 and 0.88 (alike), 0.5 (not)
        texts += [base, base.upper(), edited(base, [100]), edited(base, [50, 150, 200]), edited(base, range(0, 240, 14))]
    assert groups_of(docs(texts)) == dict(enumerate(brute_similar(texts)))


@pytest.mark.parametrize("small", [False, True])
def test_hub(docs, words, monkeypatch, small):
    """Copies of one text that are like it but not like each other, in whatever pieces their keys are taken."""
    if small:
        for name, value in (("CHUNK", 16), ("BLOCK", 20), ("CROWD", 3), ("CLUSTER", 40), ("HOT_KEY", 64), ("HELD", 300), ("WATCHED", 4), ("AT_ONCE", 3)):
            monkeypatch.setattr(neardup, name, value)
    base = words(7, 200)
    r = random.Random(1)
    texts = [edited(base, sorted(r.sample(range(5, 195), 4)), f"e{i}x") for i in range(150 if small else 500)] + [base] + [words(100 + i, 60) for i in range(50)]
    expected = brute_similar(texts)
    assert expected.count(0) > 100
    assert groups_of(docs(texts)) == dict(enumerate(expected))


@pytest.mark.parametrize("whole", [True, False])
def test_crowd_without_a_hub(docs, words, monkeypatch, whole):
    """Texts of one template: some alike, most not, so that crowded keys hold many classes."""
    monkeypatch.setattr(neardup, "BLOCK", 25)
    monkeypatch.setattr(neardup, "CLUSTER", 10**6 if whole else 2)
    monkeypatch.setattr(neardup, "CHUNK", 32)
    base = words(9, 160)
    r = random.Random(2)
    texts = []
    for i in range(60):
        one = edited(base, sorted(r.sample(range(160), 7)), f"v{i}x")
        texts += [one, edited(one, [r.randrange(160)], f"u{i}x"), edited(one, sorted(r.sample(range(160), 2)), f"t{i}x")]
    assert groups_of(docs(texts)) == dict(enumerate(brute_similar(texts)))


def test_repeated_lines(docs, words):
    """The similarity is over distinct shingles, however often a text repeats a line."""
    line = words(3, 12)
    texts = [f"{line} " * 40 + words(200 + i, 40) for i in range(8)]
    for i in range(8):
        w = words(300 + i, 100)
        texts += [w + f" {words(400 + i, 12)}" * n for n in (2, 20)]
    got = groups_of(docs(texts))
    assert got == dict(enumerate(brute_similar(texts)))
    assert [got[i] for i in range(8)] == list(range(8)) and got[9] == 8


def test_odd_rows(docs, words):
    a, b = words(1, 100), words(2, 100)
    rows = [(None, a, "en", "s", 1), (5, edited(a, [50]), "en", "s", 1), (5, b, "en", "s", 1), (7, edited(b, [40, 80]), "en", "s", 1)]
    got = sorted((r["id"] or 0, r["component_id"]) for r in neardup.similar_groups(docs(rows)).collect())
    assert got == [(0, 5), (5, 5), (5, 5), (7, 5)]
    assert neardup.similar_groups(docs([])).count() == 0


def test_keep_one(docs, words):
    a, b, c, d = (words(i, 60) for i in range(1, 5))
    row = lambda i, t: (i, t, "en", "a", 1)
    # one id with three unrelated texts, one of them copied under a greater id and one repeated; null ids with unrelated texts
    rows = [row(3, a), row(3, b), row(3, c), row(3, c), row(9, a), row(None, d), row(None, words(5, 60)), row(None, b), row(None, None), row(None, ""), row(8, words(6, 60))]
    got = sorted((repr(r["doc_id"]), r["text"] or "") for r in neardup.keep_one(docs(rows)).collect())
    assert got == sorted([("3", a), ("3", b), ("3", c), ("None", d), ("None", words(5, 60)), ("None", ""), ("8", words(6, 60))])
    assert neardup.keep_one(docs([])).count() == 0


def test_clashing_columns(docs, words):
    d = docs([words(1, 60), words(1, 60), words(2, 60)])
    taken = "id name __name __NAME_ no_id __no_id __id n __n size w0 doubts root lead key mask label".split()
    d = d.withColumns({c: F.lit("x") for c in taken})
    got = neardup.keep_one(d)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2]
    assert groups_of(d) == {0: 0, 1: 0, 2: 2}


def test_recall_by_similarity(docs, words):
    """Pairs of texts on their own, by the similarity that they have: all that the layout promises are found."""
    r = random.Random(5)
    texts = []
    for i in range(400):
        base = words(1000 + i, 150, 5000)
        texts += [base, edited(base, sorted(r.sample(range(150), 1 + i % 4)), f"q{i}x")]
    got = groups_of(docs(texts))
    bands: dict[float, list[bool]] = {}
    for i in range(0, len(texts), 2):
        x, y = shingle_set(texts[i]), shingle_set(texts[i + 1])
        j = len(x & y) / len(x | y)
        found = got[i + 1] == i
        assert not found or j >= 0.8
        if j >= 0.8:
            bands.setdefault(math.floor(j * 20) / 20, []).append(found)
    assert all(sum(b) >= 0.95 * len(b) for b in bands.values()) and sum(map(len, bands.values())) > 200
    assert all(all(b) for j, b in bands.items() if j >= 0.9)


def test_layout():
    sizes = [neardup.layout(n) for n in (0, 1000, 10**6, 10**10)]
    assert [x.width for x in sizes] == [16, 16, 26, 40]
    # entries of a text grow far more slowly than the table
    entries = [x.segments << x.doubts for x in sizes]
    assert entries == sorted(entries) and entries[-1] < 40 * entries[1] and all(64 * x.lanes >= x.segments * x.width for x in sizes)


def test_a_cut_key_is_handed_on_whole(monkeypatch):
    """Of a key with more rows than a task holds, the few rows of the last piece are handed on too, though none has a partner there."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(neardup, "HELD", 50)
    monkeypatch.setattr(neardup, "CHUNK", 16)
    r = np.random.default_rng(1)
    key = np.repeat([5, 7, 9], [3, 53, 4])
    columns = [key, np.zeros(60, np.int64), np.arange(60), r.integers(-(2**62), 2**62, 60), r.integers(-(2**62), 2**62, 60)]
    rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "mask", "name", "w0", "w1"])
    lay = neardup.Layout(20, 3, 4, 4, 0, 0, 0)
    for size in (60, 7):
        got = [n for b in neardup._partners(lay)(iter([rows.slice(i, size) for i in range(0, 60, size)])) for n in b.column("name").to_pylist()]
        assert sorted(got) == list(range(3, 56))


def test_unlike_texts_of_one_name_all_stay(docs, words, monkeypatch):
    import numpy as np

    texts = [words(i, 60) for i in range(6)] + [words(0, 60)]
    same = neardup._names

    def few(h, first):
        return np.where(same(h, first) % neardup.U64(2) == 0, neardup.U64(1), same(h, first))

    named = same(*neardup._sets([t.encode() for t in texts], 5))
    assert 1 < sum(int(x) % 2 == 0 for x in named[:6]) < 6
    monkeypatch.setattr(neardup, "_names", few)
    frame = docs(texts)
    _, names = neardup.classes(frame)
    assert not names.filter("unlike").isEmpty()
    kept = {x.doc_id for x in neardup.keep_one(frame).collect()}
    assert kept >= set(range(6))
