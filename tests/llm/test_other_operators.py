"""Sharding, mixing, language, decontamination, URL rules and toxicity, and the pipeline's stages."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidelog.llm import decontam, langid, mixing, sharding, toxicity, urlfilter
from tidelog.llm.components import components


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(-5, x) for x in range(200, 240)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    expected = {}
    for start in sorted(near):
        todo = [] if start in expected else [start]
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = start
                todo += near[x]
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(docs, words):
    texts = [*ODD, *[words(i, 200) for i in range(60)]]
    limit = 300_000
    for lim in (limit, 20_000):
        rows = sharding.shards(docs(texts), lim).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
        by = defaultdict(list)
        for r in rows:
            by[r["shard_id"]].append(r)
        for shard, rs in by.items():
            total = sum(len((r["text"] or "").encode()) + sharding.ROW_BYTES for r in rs)
            assert total <= lim or len(rs) == 1
            if "+" not in shard:
                assert rs[0]["shard_bytes"] == total
                for r in rs:
                    assert format(int(md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), "060b").startswith(shard)
    assert sharding.shards(docs([]), limit).count() == 0


def test_sharding_of_copies_of_one_key(docs, words):
    rows = [(7, words(1, 300), "en", "a", 1)] * 90 + [(None, None, None, None, None)] * 3
    got = sharding.shards(docs(rows, 4), 10_000).withColumn("b", F.coalesce(F.octet_length("text"), F.lit(0)) + sharding.ROW_BYTES)
    assert got.count() == 93
    assert got.groupBy("shard_id").agg(F.sum("b").alias("t")).filter("t > 10000").count() == 0


def water(children, budget):
    """children: {name: (cap, weight)} -> shares, by filling in rounds."""
    share, open_, left = {}, dict(children), budget
    while open_:
        w = sum(x[1] for x in open_.values())
        full = {k: c for k, (c, v) in open_.items() if c * w <= v * left}
        if not full:
            share |= {k: left * v // w for k, (c, v) in open_.items()}
            break
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        share[k] = full[k]
        left -= full[k]
        del open_[k]
    return share


def test_mixing(docs, words):
    r = random.Random(2)
    rows = [(i, words(i, r.randrange(0, 60)), r.choice(["en", "en", "en", "de", None]), r.choice(["src0"] * 6 + ["src1", "src7", "odd", None]), 1) for i in range(300)] + [(300, None, "en", "src0", None)]
    t = mixing.Targets(domain={"d0": 30, "d1": 10}, lang={"en": 10, "de": 30}, budget_pct=90, max_epochs=3)
    got = {x["id"]: (x["copies"], x["n_tokens"]) for x in mixing.mix(docs(rows), t).collect()}
    leaf = defaultdict(list)
    for i, text, lang, source, _ in rows:
        digits = source[3:] if source and source.startswith("src") else None
        leaf[f"d{int(digits) // 5}" if digits else "?", lang or "?", source or "?"].append((i, len((text or "").split())))
    caps = {k: 3 * sum(n for _, n in v) for k, v in leaf.items()}
    total = sum(caps.values()) // 3 * 90 // 100
    level, weight = {(): total}, lambda d, k: {0: t.domain, 1: t.lang, 2: t.source}[d].get(k, 10)
    for depth in range(3):
        nxt = {}
        for parent, budget in level.items():
            kids = {}
            for k, c in caps.items():
                if k[:depth] == parent:
                    kids[k[: depth + 1]] = kids.get(k[: depth + 1], 0) + c
            nxt |= water({k: (c, weight(depth, k[-1])) for k, c in kids.items()}, budget)
        level = nxt
    expected = {}
    for k, ds in leaf.items():
        size = sum(n for _, n in ds)
        whole = level[k] // size if size else 0
        rest, run = level[k] - whole * size, 0
        for i, n in sorted(ds, key=lambda x: (md5(f"42:{whole + 1}:{x[0]}".encode()).hexdigest()[:15], x[0])):
            run += n
            if whole + (run <= rest):
                expected[i] = (whole + (run <= rest), n)
    assert got == expected
    assert mixing.mixed_documents(docs(rows), t).groupBy("doc_id").count().filter("count > 3").count() == 0
    assert mixing.mixed_documents(docs(rows), t).count() == sum(c for c, _ in expected.values())
    assert mixing.mix(docs([]), t).count() == 0


def test_language(spark, docs):
    r = random.Random(3)
    syllables = {"aa": "ka ru mi to na".split(), "bb": "sch eit ung ver ber".split(), "cc": "oux elle ment tion eau".split()}
    text = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(40))
    rows = [(i, text(c), c, "s", 1) for i in range(240) for c in [list(syllables)[i % 3]]] + [(900 + i, t, None, None, None) for i, t in enumerate([None, "", "12 34! ½ Ⅷ_", *ODD[4:]])]
    d = docs(rows)
    got = {x["id"]: x for x in langid.identify(d, langid.train(d)).collect()}
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert all(got[i]["lang_pred"] == c for i, _, c, *_ in rows[:240]) and all(0 <= x["score"] <= 1 for x in got.values())
    assert {got[900 + i]["lang_pred"] for i in range(3)} == {"und"}
    # every prediction again, by the kernel's definition on sets of byte n-grams
    import numpy as np

    m = langid.train(d)
    spelled = [int(k) for k in m.grams.keys]
    grams = [bytes(k >> 8 * i & 255 for i in range(k >> 40)) for k in spelled]
    held = lambda t: {g for g in grams if g in (t or "").lower().encode()}
    marks = [{g for g, x in zip(grams, row, strict=True) if x} for row in m.landmarks]
    for i, t, *_ in [*rows[:30], *rows[243:]]:
        own = held(t)
        k = np.array([len(own & x) / np.sqrt(max(1, len(own)) * max(1, len(x))) for x in marks])
        f = k @ m.weights + m.bias
        lettered = any(map(str.isalpha, t or ""))
        assert got[i]["lang_pred"] == (m.langs[int(f.argmax())] if lettered else "und")
        assert got[i]["score"] == pytest.approx(min(1, max(0, (f.max() + 1) / 2)) if lettered else 0, abs=1e-4)
    none = docs([(1, "abc", None, None, None)])
    assert langid.train(none) is None and langid.identify(none, None).first()["lang_pred"] == "und"


def test_decontamination(spark, docs, words):
    items = [(1, words(1, 40, 5000)), (2, words(2, 25, 5000)), (3, None), (4, "two words"), (1, words(1, 40, 5000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = words(1, 40, 5000).split()
    for i in (4, 11, 19, 30):
        edited[i] = "edit"
    del edited[25]
    half = " ".join(words(2, 25, 5000).split()[:8])
    texts = [*ODD, words(5, 100, 5000) + " " + words(1, 40, 5000).upper() + ", " + words(6, 50, 5000), words(7, 80, 5000) + " " + " ".join(edited), half + " " + words(8, 90, 5000), words(9, 500, 5000), words(2, 25, 5000).replace(" ", ",\n")]
    got = {(x["id"], x["item_id"]): x for x in decontam.matches(docs(texts), bench).collect()}
    n = len(ODD)
    assert set(got) == {(n, 1), (n + 1, 1), (n + 4, 2)}
    assert (got[n, 1]["score"], got[n, 1]["first_word"], got[n, 1]["end_word"]) == (1.0, 100, 140)
    assert 0.7 < got[n + 1, 1]["score"] < 1
    many = {(x["id"], x["item_id"]) for x in decontam.matches(docs(texts), bench, block_seeds=30).collect()}
    assert many == set(got)
    kept = {x["doc_id"] for x in decontam.clean(docs(texts), bench).collect()}
    assert kept == set(range(len(texts))) - {n, n + 1, n + 4}
    assert decontam.matches(docs(texts), bench.limit(0)).count() == 0 and decontam.matches(docs([]), bench).count() == 0


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment():
    import numpy as np

    r = random.Random(4)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 14))] for _ in range(2))
        score, start, end = decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == brute_align(a, b) == brute_align(a, b[start:end])


def test_decontamination_of_edited_copies(spark, docs, words):
    """No whole copy is in the corpus; every pair is aligned without seeds."""
    r = random.Random(6)
    items = [words(20 + i, n, 3000).split() for i, n in enumerate((20, 38, 59, 24))]
    items[3][5] = "überfluß"
    texts = []
    for i, w in enumerate(items):
        for edits in range(1, len(w) // 3):
            e = list(w)
            for k in range(edits):
                at = (k * len(w) // edits + r.randrange(2)) % len(w)
                e[at] = f"{e[at]} new{k}" if edits % 2 else f"new{k}"
            texts.append(" ".join([words(90 + i, 30, 3000), *e, words(70 + edits, 20, 3000)]))
    inserted = " ".join(x if k % 2 else f"{x} more{k}" for k, x in enumerate(items[2]))
    texts += [inserted.replace(" more56", ""), "ÜBERFLUSS ".join([" ".join(items[3][:5]) + " ", " ".join(items[3][6:])]).upper()]
    expected = {}
    for t, text in enumerate(texts):
        b = text.casefold().split()
        for i, w in enumerate(items):
            a = [x.casefold() for x in w]
            seeds = {tuple(a[k : k + 3]) for k in range(len(a) - 2)}
            score = brute_align(a, b) / (2 * len(a))
            if score >= decontam.THRESHOLD and any(tuple(b[k : k + 3]) in seeds for k in range(len(b) - 2)):
                expected[t, i] = round(score, 6)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["id"], x["item_id"]): x["score"] for x in decontam.matches(docs(texts), bench).collect()}
    assert got == expected and len(got) > 30 and expected[len(texts) - 1, 3] == 1 and (len(texts) - 2, 2) in expected


def test_urls(spark):
    hosts = (urlfilter.HostRule("net", "/", "block"), urlfilter.HostRule("example.net", "/en/", "allow"), urlfilter.HostRule("example.com", "/de/", "block"))
    pages = {
        1: ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("http://a.Example.NET/x?y", "a.example.net", "/x", "net/", "block"),
        3: ("http://a.net", "a.net", "", None, "allow"), 4: ("HTTP://badexample.com/de/?q", "badexample.com", "/de/", None, "allow"), 5: (None, "", "", None, "allow"), 6: ("nothing", "", "", None, "allow"),
        7: ("https://www.cheap-pills.example.org/a#b", "www.cheap-pills.example.org", "/a", None, "block"), 8: ("x://example.com/de/#/en/", "example.com", "/de/", "example.com/de/", "block"), 9: ("http://ads.x.org?z", "ads.x.org", "", None, "block"), 10: ("", "", "", None, "allow"),
    }
    f = spark.createDataFrame([(k, v[0]) for k, v in pages.items()] * 2, "page_id long, url string")
    few = [p for p in urlfilter.DEFAULT_PATTERNS if re.search(r"\b(ad|pill)\b", p.pattern.replace("s?", " "))]
    for patterns, block in ((urlfilter.DEFAULT_PATTERNS, 10_000), (few, 4)):
        rows = urlfilter.judge(f, hosts, patterns, block=block).collect()
        assert len(rows) == 20 and all((r["host"], r["path"], r["rule"], r["verdict"]) == pages[r["id"]][1:] for r in rows)
    assert urlfilter.judge(f.limit(0), hosts).count() == 0


def test_index_against_every_rule():
    """Random URLs: the tokens of the rules fetch every rule that fits, whichever of them is the rarest, and few others."""
    r = random.Random(7)
    words = [*urlfilter.UNWANTED, "free", "online", "cheap", "news", "a1", "track"]
    some = lambda: r.choice(words) + r.choice(["", "", "s", "x"])
    label = lambda: r.choice(["-", "", "."]).join(some() for _ in range(r.randrange(1, 4)))
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'www.', 'a-b.'])}{label()}.{r.choice(['com', 'net', ''])}{r.choice(['', '/', '?', '#'])}{'/'.join(label().title() for _ in range(r.randrange(3)))}{r.choice(['', '/', '.html', '?a=b'])}" for _ in range(1500)]
    urls += [f"http://{n}.x.com/" for n in "free-bet buy-pill cheap-pill ad ads adserver bets-a casinos poker slots spam-a1 doubleclick".split()]
    one = [(p, re.compile(p.pattern)) for p in urlfilter.DEFAULT_PATTERNS]
    literals = sorted({t for p in urlfilter.DEFAULT_PATTERNS for x in p.demands() for t in x})
    assert len(one) > 200
    for _ in range(3):
        index = urlfilter.Index([], urlfilter.DEFAULT_PATTERNS, {t: r.randrange(9) for t in literals})
        tried = blocked = 0
        for u in urls:
            low = u.lower()
            fits = {p.pattern for p, x in one if x.search(low)}
            fetched = {p.pattern for p in index.candidates(low)}
            assert fits <= fetched, u
            assert index.judge(u)[3] == ("block" if fits else None), u
            tried, blocked = tried + len(fetched), blocked + bool(fits)
        assert 200 < blocked < len(urls) and tried < 0.1 * len(urls) * len(one)
    assert index.judge("http://buy-pill.x.com/")[3] == index.judge("http://free-bet.x.com/")[3] == "block"


def test_demands():
    f = frozenset
    spelled = {
        r"://ads?\.": {f({"ad"}), f({"ads"})}, r"/(?:cheap|buy)-pills?/": {f({"cheap", "pill"}), f({"cheap", "pills"}), f({"buy", "pill"}), f({"buy", "pills"})},
        r"[/.]track[ab]\.": {f({"tracka"}), f({"trackb"})}, r"^http://x+/ab/$": {f({"http", "ab"}), f({"http", "ab", "x"})}, r"\.a(?:-b)*-c\.": {f({"a", "c"}), f({"a", "b", "c"})},
        r"/[^a-z0-9]ab[^0-9a-z]": {f({"ab"})}, r"/ab-\d+-cd/": {f({"ab", "cd"})}, r"(?i)/(ab){2}/": {f({"abab"})},
    }
    for pattern, expected in spelled.items():
        assert {x for x in urlfilter.demands(pattern) if not any(y < x for y in urlfilter.demands(pattern))} >= {x for x in expected if not any(y < x for y in expected)}, pattern
    for pattern in (r"casino", r"/\d+/", r"://ads?", r"/(?:porn|x*)/", r"\bab\b", r"/[a-z]b/"):
        with pytest.raises(ValueError):
            urlfilter.demands(pattern)


def test_rarest_token():
    p = urlfilter.PatternRule("/(?:common-rare|rare2)/")
    index = urlfilter.Index([], [p], {"common": 9, "rare": 1})
    assert set(index.by_token) == {"rare", "rare2"}


def test_grammar():
    m = toxicity.Model({"widiot", "wtrash"}, {"plowei"})
    assert m.clauses("You idiot. Nice day! He said you idiot, trash.") == "Iri"
    assert m.clauses("this is not an idiot") == "n" and m.clauses("I will kill you") == "T" and m.clauses("kill the process") == "t" and m.clauses("you I will kill") == "T"
    assert m.clauses("the idiot over there, you") == "i" and m.clauses("what an idiot you are") == "I"
    assert m.clauses("clean text") == "" and m.clauses("loweige") == "w" and m.clauses("loweige you are") == "W" and m.clauses("never a loweige") == "v" and m.clauses("she said loweige") == "s"
    assert m.score(None) == m.score("") < toxicity.THRESHOLD and m.score("") < m.score("loweige") < m.score("trash") < m.score("you trash. you idiot")
    assert m.score("I will not hurt you") < toxicity.THRESHOLD < m.score("I will hurt you")


def read_by_hand(symbols, reach=3):
    """A clause's strongest kind, by looking at each of its words alone."""
    out = []
    for clause in "".join(symbols).split(toxicity.END)[:-1]:
        found = []
        for i, x in enumerate(clause):
            if x not in toxicity.SOUGHT:
                continue
            if toxicity.NEGATION in clause[max(0, i - reach) : i]:
                found.append(toxicity.NEGATED[x])
            elif toxicity.REPORT in clause[:i]:
                found.append(toxicity.REPORTED[x])
            else:
                found.append(toxicity.AIMED[x] if toxicity.TARGET in clause else x)
        if found:
            out.append(max(found, key=list(toxicity.KINDS).index))
    return "".join(out)


def test_composition_against_each_word_alone():
    r = random.Random(8)
    g = toxicity.grammar()
    words = (toxicity.OTHER, toxicity.INSULT, toxicity.WEAK, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.END)
    for _ in range(4000):
        symbols = [*r.choices(words, weights=(4, 2, 2, 2, 1, 1, 1, 2), k=r.randrange(25)), toxicity.END]
        state, out = g.start, ""
        for x in symbols:
            state, written = g.arcs[state, x]
            out += written
        assert out == read_by_hand(symbols), symbols


def test_learned_classes_and_ablation(spark, docs):
    """Where labels follow who is meant and what is denied or quoted, the classes are learned, and without a transducer verdicts change."""
    r = random.Random(6)
    some = ["".join(r.choice("aeioumnrtlsd") for _ in range(6)) for _ in range(400)]
    fill = lambda n: " ".join(r.choices(some, k=n))
    frames = [("zork", 0), ("vusu zork", 1), ("zork vusu", 1), ("you zork", 1), ("keto zork", 0), ("not a zork", 0), ("said zork", 0), ("blarg", 1), ("not a blarg", 0), ("wrote blarg", 0), (f"vusu {fill(5)} keto", 0)]
    rows, labels = [], []
    for i in range(1100):
        text, toxic = frames[i % len(frames)]
        rows.append((i, f"{fill(6)}. {fill(3)} {text} {fill(3)}. {'vusu keto. ' * (not toxic)}{fill(9)}.", "en", "s", 1))
        labels.append((i, toxic))
    # plain uses beyond the frames make both families insults of some kind
    for i in range(1100, 1700):
        rows.append((i, f"{fill(4)} {r.choice(['blarg', 'zork'])} {fill(4)} {r.choice(['blarg', 'vusu zork'])}", "en", "s", 1))
        labels.append((i, 1))
    d, lab = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train(d, lab)
    assert "vusu" in m.targets and "keto" in m.softeners and not {"vusu", "keto"} & toxicity.TARGETS
    verdicts = lambda x: [x.score(t) >= toxicity.THRESHOLD for _, t, *_ in rows]
    full, truth = verdicts(m), [bool(y) for _, y in labels]
    wrong = lambda v: sum(a != b for a, b in zip(v, truth, strict=True))
    assert wrong(full) < 0.07 * len(rows)
    for part in toxicity.PARTS:
        changed = verdicts(m.without(part))
        assert sum(a != b for a, b in zip(changed, full, strict=True)) >= 50 and wrong(changed) > wrong(full), part


@pytest.mark.parametrize("a, b", ["“”", "«»", "¿?", "¡!", "…—", "–…", "\u00a0\u00a0", "‘’"])
def test_grammar_beside_other_punctuation(a, b):
    m = toxicity.Model({"widiot", "pmoro"}, {"plowei"})
    for text, kinds in (("{}idiot{}", "i"), ("you {}morons{} there", "I"), ("{}loweige{}", "w"), ("I will {}kill{}", "t"), ("not {}idiot{}", "n"), ("{}nice{}", "")):
        assert m.clauses(text.format(a, b)) == kinds
    assert {w for w, _ in toxicity._uses(f"a {a}zork{b} b")} == {"zork"}


def test_toxicity(spark, docs, words):
    r = random.Random(5)
    bad = ["zork", "blarg", "fleeming"]
    rows, labels = [], []
    for i in range(300):
        w = words(i, 60).translate(str.maketrans("0123456789", "abcdefghij")).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(60), r.choice(bad) + (r.choice(["", "ab", "ba"])))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, None if i % 50 == 1 else int(toxic)))
    rows += [(900 + i, t, None, None, None) for i, t in enumerate(ODD)]
    d, lab = docs(rows), spark.createDataFrame(labels * 2, "doc_id long, toxic int")
    m = toxicity.train(d, lab)
    got = {x["id"]: x for x in toxicity.score(d, m).collect()}
    assert all((got[i]["score"] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in range(300))
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    assert {x["doc_id"] for x in toxicity.drop_toxic(d, m).collect()} == {i for i, x in got.items() if x["score"] < toxicity.THRESHOLD}
    assert toxicity.train(d, lab.limit(0)).insults.has("idiot")
    # every score again, clause by clause
    import math

    for i, t, *_ in rows:
        tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n]", (t or "").lower() + "\n")
        kinds = read_by_hand([toxicity.END if x in ".!?;:,\n" else m.symbol(x) for x in tokens])
        assert got[i]["clauses"] == kinds
        z = m.weights[-1] + (m.weights[-2] * math.log2(sum(x in ".!?;:,\n" for x in tokens)) if kinds else 0)
        for n, k in enumerate(toxicity.PRIOR):
            if k in kinds:
                z += m.weights[n] + m.weights[len(toxicity.PRIOR) + n] * math.log2(kinds.count(k))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)))


#: Names that operators use inside or give their results.
TAKEN = "id h bytes p t score row depth full total shard page seq part shard_id shard_depth SHARD_BYTES tie copies row_id key n_tokens domain bucket upto held_out clauses item_id words start name __name".split()


def test_extra_columns(spark, docs, words):
    d = docs([words(i, 30) for i in range(6)]).withColumns({c: F.lit("x") for c in TAKEN})
    placed = sharding.shards(d, 500)
    assert placed.columns == [*d.columns, "shard_id_", "shard_depth_", "shard_bytes_"]
    assert {(r["shard_id"], r["doc_id"]) for r in placed.collect()} == {("x", i) for i in range(6)}
    assert len({r["shard_id_"] for r in placed.collect()}) > 1
    assert sharding.shards(d.limit(0), 500).columns == placed.columns
    bench = spark.createDataFrame([(1, words(2, 30))], "item_id long, text string").withColumns({"doc_id": F.lit(1), "t": F.lit(2)})
    for out in (mixing.mixed_documents(d), toxicity.drop_toxic(d, toxicity.Model()), decontam.clean(d, bench)):
        assert out.columns == d.columns and all(r["tie"] == "x" for r in out.collect())
    assert sorted(r["doc_id"] for r in decontam.clean(d, bench).collect()) == [0, 1, 3, 4, 5]
    for out in (langid.identify(d, None), toxicity.score(d, toxicity.Model()), mixing.mix(d), decontam.matches(d, bench), urlfilter.judge(d.withColumns({"page_id": F.col("doc_id"), "url": F.col("text"), "host": F.lit(1), "verdict": F.lit(1)}))):
        assert out.count() >= 1


def test_mixing_of_odd_rows(docs, words):
    """Rows that share an id, or have none, are chosen for themselves."""
    rows = [(7, words(i, 20), "en", "src1", 1) for i in range(6)] + [(None, words(50 + i, 20), "en", "src1", 1) for i in range(6)] + [(None, None, None, None, None)] * 2
    out = mixing.mixed_documents(docs(rows), mixing.Targets(budget_pct=50, max_epochs=2)).collect()
    used = [r["text"] for r in out if r["text"]]
    assert len(used) == len(set(used)) == 6


def test_package_for_executors():
    import zipfile
    from pathlib import Path

    from tidelog.llm import kernels

    names = zipfile.ZipFile(kernels.packed(Path(kernels.__file__).resolve().parents[2])).namelist()
    assert {"tidelog/__init__.py", "tidelog/llm/kernels.py", "tidelog/llm/neardup.py"} <= set(names)


SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Each stage against its own operator's verdicts on its input."""
    import os

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    import corpus_pipeline as cp
    from tests.llm.test_neardup import brute_similar
    from tidelog.llm import kernels

    at = spark.read.parquet(f"{SF}/documents.parquet")
    names, ids = at.columns, lambda f: sorted(r[0] for r in f.select("doc_id").collect())
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = kernels.cut(cp.drop_toxic(spark, at, SF))
    assert ids(one) == sorted(r["id"] for r in toxicity.score(at, toxicity.train(at, labels)).collect() if r["score"] < 0.3)
    two = kernels.cut(cp.drop_near_duplicates(spark, one, SF))
    kept = sorted((r["doc_id"], r["text"]) for r in one.collect())
    assert ids(two) == sorted({kept[i][0] for i in brute_similar([t for _, t in kept])})
    three = kernels.cut(cp.drop_contaminated(spark, two, SF))
    assert ids(three) == sorted(set(ids(two)) - {r["id"] for r in decontam.matches(two, bench).collect()})
    four = kernels.cut(cp.mix_sources(spark, three, SF))
    assert ids(four) == sorted(r["id"] for r in mixing.mix(three, cp.MIX).collect() for _ in range(r["copies"]))
    five = cp.shard(spark, four, SF)
    assert ids(five) == ids(four) and all(f.columns == names for f in (one, two, three, four)) and len(cp.STAGES) == 5


def test_language_with_many_labels(docs, monkeypatch):
    """Hundreds of label values need no column each; every learned one can be told."""
    r = random.Random(8)
    alphabet = [chr(0x4E00 + i) for i in range(600)]
    rows = []
    for c in range(300):
        own = alphabet[2 * c : 2 * c + 2]
        rows += [(1000 * c + i, " ".join("".join(r.choice(own) for _ in range(3)) for _ in range(8)), f"l{c:03d}", "s", 1) for i in range(12)]
    monkeypatch.setattr(langid, "MOST_TEXTS", 3000)
    frame = docs(rows, 4)
    got = langid.identify(frame, langid.train(frame)).collect()
    true = {x[0]: x[2] for x in rows}
    held = [x for x in got if x.held_out]
    assert len(got) == len(rows) and sum(x.lang_pred == true[x.id] for x in held) > 0.9 * len(held)
