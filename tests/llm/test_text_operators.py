"""Quality, SimHash, token counts and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidelog.llm import quality, simhash, substring, tokencount


def split(text):
    return (text or "").encode().split()


def brute_quality(text):
    w = split(text)
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, words):
    texts = [*ODD, words(1, 300), words(2, 50) + "\n" + words(2, 50) + "\n\n" + words(2, 50), "a\nb\na\n \na", words(3, 40, 3), "#a $$ <b>", "— 😀 “é” ½ Ⅷ 中"]
    led = quality.ledger(docs(texts))
    got = {r["id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in led.collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    letters = {r["id"]: r["n_letters"] for r in led.collect()}
    assert letters == {i: sum(map(str.isalpha, t or "")) for i, t in enumerate(texts)}
    ab = {r["rule"]: r for r in quality.ablation(led).collect()}
    kept = quality.apply_policy(led).filter("kept").count()
    for rule, r in ab.items():
        rest = quality.Policy("x", tuple(x for x in quality.STANDARD.rules if x != rule))
        assert r["n_kept_without"] == quality.apply_policy(led, rest).filter("kept").count() == kept + r["n_only"]
    assert quality.ablation(led.limit(0)).filter("n_failed <> 0 or n_kept_without <> 0").count() == 0


def brute_fp(text, k):
    w = split((text or "").encode().lower().decode())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, words):
    texts = [*ODD]
    for s in range(12):
        base = words(s, 120).split()
        texts.append(" ".join(base))
        for k in range(4):
            other = list(base)
            other[10 * k] = "edit"
            texts.append(" ".join(other).upper() if k % 2 else " ".join(other))
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.groups(docs(texts), 3).collect()}
    fps = [brute_fp(t, 3) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == brute_components(fps, 2)


def test_links_of_crowded_buckets(spark):
    r = random.Random(3)
    hi = r.getrandbits(32)
    fps = {hi << 32 | r.getrandbits(6) for _ in range(60)}
    fps |= {(hi ^ 1 << r.randrange(32)) << 32 | r.getrandbits(6) for _ in range(60)} | {r.getrandbits(32) << 32 | 7 for _ in range(30)} | {r.getrandbits(64) for _ in range(50)}
    fps |= {(7 ^ 1 << a ^ 1 << b) << 32 | 7 for a in range(6) for b in range(a)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowd in (2, 5, 1000):
        edges = simhash.links(frame, 2, crowd).collect()
        assert all(bin((e["a"] ^ e["b"]) % 2**64).count("1") <= 2 for e in edges)
        number = {x: i for i, x in enumerate(signed)}
        root = list(range(len(fps)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for e in edges:
            a, b = sorted((find(number[e["a"]]), find(number[e["b"]])))
            root[b] = a
        assert [find(i) for i in range(len(fps))] == brute_components(fps, 2)


def brute_dedup(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = split(t)
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if x in seen else set()
            seen.add(x)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("group", [1, 50_000])
def test_substring(docs, words, group):
    r = random.Random(4)
    passage = words(99, 60)
    texts = [*ODD, *[f"{words(i, r.randrange(5, 80))} {passage if i % 3 else words(i % 5 + 200, 30)} {words(i + 50, 30)}" for i in range(40)], "a b " * 60, words(7, 19), passage, passage.replace(" ", "\n")]
    got = {x["id"]: x for x in substring.dedup(docs(texts), group=group).collect()}
    assert {i: (x["n_words"], x["n_removed"], x["kept_sha256"]) for i, x in got.items()} == brute_dedup(list(enumerate(texts)))
    assert all(sum(s["end"] - s["start"] for s in x["spans"]) == x["n_removed"] for x in got.values())


def test_substring_ids(docs, words):
    p = words(1, 30)
    rows = [(None, p, "en", "a", 1), (2, p, "en", "a", 1), (2, p, "en", "a", 1), (1, p, "en", "a", 1)]
    got = sorted((repr(r["id"]), r["n_removed"]) for r in substring.dedup(docs(rows)).collect())
    assert got == [("1", 0), ("2", 30), ("2", 30), ("None", 0)]
    assert substring.dedup(docs([])).count() == 0


def test_tokens(docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    count = lambda x: len(lib.encode(x, add_special_tokens=False).ids)
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "'", "'re", "'ll", "é", "中", "<|endoftext|>", "<|endof", "12", "...", "　", "ing", "\U0001f600", "\x1c", "²", "_"]
    texts = [*ODD[:4], *ODD[5:8], "x" * 3000, *["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(150)]]
    got = {x["id"]: x for x in tokencount.counts(docs(texts), path, store=True).withColumns({"at3": tokencount.tokens_at(F.col("upto"), F.lit(3)), "fit": tokencount.fits(F.col("upto"), 2)}).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i]["upto"] == [count(t[:k]) for k in range(len(t) + 1)]
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["at3"]) == (len(t.encode()), count(t), count(t[:3]))
        assert got[i]["fit"] == max(k for k in range(len(t) + 1) if count(t[:k]) <= 2)
    for budget in (0, 1, 2, 5, 9):
        plain = {x["id"]: (x["n_tokens"], x["fit_chars"]) for x in tokencount.counts(docs(texts), path, budget=budget).collect()}
        assert plain == {i: (x["n_tokens"], max(k for k, n in enumerate(x["upto"]) if n <= budget)) for i, x in got.items()}


def test_subtree_against_all_pairs():
    """Marks of one group's suffixes: every window that a leaf before has as well, and no other."""
    r = random.Random(9)
    for _ in range(300):
        window = r.choice((3, 5, 8))
        leaves, owned, same = [], {}, r.choice((2, 3))
        for key in range(r.choice((2, 2, r.randrange(2, 14)))):
            lead = r.randrange(window)
            n = r.randrange(1, lead + 2)
            w = [r.choice("ab") * (1 if r.random() < 0.8 else r.randrange(1, 3)) for _ in range(n + window - 1)]
            start = r.randrange(50)
            leaves.append((key // same, start, lead, n, " ".join(w).encode()))
            for j in range(n):
                # a leaf's windows count by where they stand around its suffix
                owned.setdefault((lead - j, tuple(w[j : j + window])), []).append((key // same, start + j))
        r.shuffle(leaves)
        expected = sorted(p for places in owned.values() for p in places if p != min(places))
        assert sorted((a, b) for a, b, _ in substring.subtree(leaves, window)) == expected
        if len(leaves) == 2:
            both = sorted(leaves, key=lambda x: (x[0], x[1] + x[2]))
            assert sorted((a, b + j) for a, b, n in substring._two(*both, window) for j in range(n)) == expected
