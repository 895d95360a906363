"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, possible insult, threat, target, negation, report (of speech), clause end, other.  Small
transducers, each reading symbols and writing symbols, are composed into one machine: ``negation`` turns an insult, possible
insult or threat in the next words into its negated kind, ``reported`` turns what follows a verb of reporting in the clause into its
reported kind, ``aimed`` makes it aimed where a target stands before or behind it in the clause, and ``scorer`` writes, at the
clause's end, its strongest kind.  So a text is read as the kinds of its matched clauses.

The score is a logistic function of these kinds: which there are, how many, and among how many clauses.  Words have no score of their own.

All of it is learned from about ``SAMPLE`` labelled texts, chosen by a hash of the id.  The insults (whole words and word
beginnings) are families whose different uses, each a word with the one before it, stand in toxic texts beyond chance, so that copies of one text
count once.  Targets and softeners (negations in effect) are added to the fixed lists where the labels show them: words beside an
insult with which it is toxic more often, or less often, than without, beyond chance.  The weights are a ridge fit around
``PRIOR``, so a kind that the labels do not show keeps the meaning it has by default.

Defined cases: null and wordless texts have the score of a text without a match; without labels
a small built-in lexicon and the default weights serve; repeated rows are scored each; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels
from tidelog.llm.langid import held_out

SAMPLE = 12_000
LEAST_CONTEXTS = 3
PRECISION = 0.6
CERTAIN = 0.97
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
KNOWN = 200_000
#: Words on either side of an insult among which targets and softeners are looked for.
BESIDE = 3

TARGETS = frozenset("you your yourself he she they him her them du dich dir ihr euch sie tu te toi vous tú usted ustedes ti".split())
NEGATIONS = frozenset("not never no nobody isn't aren't wasn't nicht kein keine nie pas jamais aucun nunca".split())
REPORTS = frozenset("said says say wrote writes called reported quoted told sagte schrieb nannte dit écrit disait dijo escribió".split())
THREATS = frozenset("kill hurt destroy beat shoot stab töten umbringen tuer frapper matar golpear".split())
BUILT_IN = frozenset("idiot moron scum stupid worthless".split())

OTHER, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, END = "oiwtyNR#"
#: Symbols without which no clause matches.
SOUGHT = frozenset((INSULT, WEAK, THREAT))
#: What a plain kind becomes where it is negated, reported or aimed.
NEGATED = {WEAK: "v", INSULT: "n", THREAT: "m"}
REPORTED = {WEAK: "s", INSULT: "r", THREAT: "q"}
AIMED = {WEAK: "W", INSULT: "I", THREAT: "T"}
#: Kinds that the transducers write, from the weakest to the strongest.
KINDS = {
    "v": "negated possible insult", "s": "reported possible insult", "m": "negated threat", "q": "reported threat", "t": "threat without a target", "w": "possible insult",
    "W": "aimed possible insult", "n": "negated insult", "r": "reported insult", "i": "insult", "T": "aimed threat", "I": "aimed insult",
}
#: Default weight of a kind's presence, of each doubling of its number, of the number of clauses, and of nothing, in log odds.
PRIOR = {"v": 0.0, "s": 0.0, "m": 0.0, "q": 0.3, "t": 0.5, "w": 1.0, "W": 1.6, "n": 1.0, "r": 1.2, "i": 3.5, "T": 4.0, "I": 4.5}
MORE, CLAUSES, NOTHING = 0.5, 0.0, -3.5
RIDGE = 0.5
ALPHABET = (OTHER, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, END, *NEGATED.values(), *REPORTED.values(), *AIMED.values())


@dataclass
class Transducer:
    """A sequential transducer: (state, symbol) -> (state, what it writes).  Missing arcs copy and stay."""

    start: object = 0
    arcs: dict[tuple[object, str], tuple[object, str]] = field(default_factory=dict)

    def go(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, nxt: Transducer) -> Transducer:
        """Composition: what this one writes, the next one reads.  States are the reachable pairs."""
        out = Transducer((self.start, nxt.start))
        todo = [out.start]
        seen = {out.start}
        while todo:
            a, b = pair = todo.pop()
            for s in ALPHABET:
                a2, written = self.go(a, s)
                b2, text = b, ""
                for x in written:
                    b2, w = nxt.go(b2, x)
                    text += w
                out.arcs[pair, s] = ((a2, b2), text)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


def negation(reach: int = 3) -> Transducer:
    """An insult, possible insult or threat among the next words after a negation is negated."""
    t = Transducer()
    for left in range(reach + 1):
        t.arcs[left, NEGATION] = (reach, OTHER)
        t.arcs[left, END] = (0, END)
        for s in (OTHER, TARGET, REPORT):
            t.arcs[left, s] = (max(0, left - 1), s)
        for s, negated in NEGATED.items():
            t.arcs[left, s] = (max(0, left - 1), negated if left else s)
    return t


def reported() -> Transducer:
    """After a verb of reporting, the rest of the clause is somebody else's."""
    t = Transducer()
    for state in (0, 1):
        t.arcs[state, REPORT] = (1, OTHER)
        t.arcs[state, END] = (0, END)
    for s, said in REPORTED.items():
        t.arcs[1, s] = (1, said)
    return t


def aimed() -> Transducer:
    """A target anywhere in the clause makes its plain kinds aimed.

    State: whether a target has come, and the plain kinds that wait for one; the end of the clause writes what still waits.
    """
    t = Transducer((False, ""))
    plain = [k for k in KINDS if k in AIMED]
    for chosen in range(1 << len(plain)):
        waits = "".join(k for i, k in enumerate(plain) if chosen >> i & 1)
        t.arcs[(False, waits), END] = ((False, ""), waits + END)
        t.arcs[(False, waits), TARGET] = ((True, ""), "".join(AIMED[k] for k in waits))
        for s in plain:
            t.arcs[(False, waits), s] = ((False, "".join(k for k in plain if k in waits + s)), "")
    for s, at_somebody in AIMED.items():
        t.arcs[(True, ""), s] = ((True, ""), at_somebody)
    t.arcs[(True, ""), END] = ((False, ""), END)
    return t


def scorer() -> Transducer:
    """Writes, at a clause's end, its strongest kind; nothing else."""
    t = Transducer("")
    order = ["", *KINDS]
    for state in order:
        for s in ALPHABET:
            if s in KINDS:
                t.arcs[state, s] = (max(state, s, key=order.index), "")
            else:
                t.arcs[state, s] = ("", state) if s == END else (state, "")
    return t


#: The transducers before the scorer, by name.
PARTS = {"negation": negation, "reported": reported, "aimed": aimed}


def grammar(parts: Iterable[str] = tuple(PARTS)) -> Transducer:
    """The named transducers and the scorer, composed."""
    out = None
    for name in parts:
        out = PARTS[name]() if out is None else out.then(PARTS[name]())
    return scorer() if out is None else out.then(scorer())


_WORD = r"[^\W\d_]+(?:'[^\W\d_]+)?"
_TOKEN = re.compile(_WORD + r"|[.!?;:,\n]")
_WORD = re.compile(_WORD)
_ENDS = ".!?;:,\n"


class Words:
    """Whole words ``w...`` and word beginnings ``p...``."""

    def __init__(self, features: Iterable[str]):
        self.whole = frozenset(f[1:] for f in features if f[0] == "w")
        self.stems = frozenset(f[1:] for f in features if f[0] == "p")
        self.sizes = sorted({len(s) for s in self.stems})

    def has(self, w: str) -> bool:
        return w in self.whole or any(w[:n] in self.stems for n in self.sizes)


class Model:
    """Lexicon, word classes, composed grammar and the weights of its kinds."""

    def __init__(self, insults: Iterable[str] = frozenset("w" + x for x in BUILT_IN), possible: Iterable[str] = (), targets: Iterable[str] = (), softeners: Iterable[str] = (), weights: np.ndarray | None = None, parts: Iterable[str] = tuple(PARTS)):
        self.insults, self.possible = Words(tuple(insults)), Words(tuple(possible))
        self.targets, self.softeners = TARGETS | set(targets), NEGATIONS | set(softeners)
        self.weights = prior() if weights is None else weights
        self.machine = self.start = None
        self.compose(parts)
        self._known: dict[str, str] = {}

    def compose(self, parts: Iterable[str]) -> None:
        g = grammar(parts)
        self.machine, self.start = g.arcs, g.start

    def without(self, *names: str) -> Model:
        """The same lexicon and weights with some transducers left out of the composition."""
        out = Model(weights=self.weights, parts=[p for p in PARTS if p not in names])
        out.insults, out.possible, out.targets, out.softeners = self.insults, self.possible, self.targets, self.softeners
        return out

    def symbol(self, w: str) -> str:
        """A word's symbol; those of up to ``KNOWN`` words are kept."""
        if (found := self._known.get(w)) is None:
            if len(self._known) >= KNOWN:
                self._known.clear()
            found = self._known[w] = self._symbol(w)
        return found

    def _symbol(self, w: str) -> str:
        for s, known in ((NEGATION, self.softeners), (TARGET, self.targets), (REPORT, REPORTS)):
            if w in known:
                return s
        if self.insults.has(w):
            return INSULT
        if self.possible.has(w):
            return WEAK
        return THREAT if w in THREATS else OTHER

    def read(self, text: str) -> tuple[str, int]:
        """The kinds of the text's matched clauses, in order, and the number of its clauses."""
        tokens = _TOKEN.findall(text.lower() + "\n")
        symbols = {x: END if x in _ENDS else self.symbol(x) for x in set(tokens)}
        size = sum(map(tokens.count, _ENDS))
        if SOUGHT.isdisjoint(symbols.values()):
            return "", size
        state, out = self.start, []
        for x in tokens:
            state, written = self.machine[state, symbols[x]]
            if written:
                out.append(written)
        return "".join(out), size

    def clauses(self, text: str) -> str:
        return self.read(text)[0]

    def weigh(self, kinds: str, size: int) -> float:
        return float(1 / (1 + math.exp(-features(kinds, size) @ self.weights)))

    def score(self, text: str | None) -> float:
        return self.weigh(*self.read(text or ""))


def prior() -> np.ndarray:
    return np.array([*PRIOR.values(), *[MORE] * len(PRIOR), CLAUSES, NOTHING])


_COLUMN = {k: i for i, k in enumerate(PRIOR)}


def features(kinds: str, size: int) -> np.ndarray:
    """For each kind whether it is there and the logarithm of its number, then of the number of clauses where any kind is there, and 1."""
    x = np.zeros(2 * len(PRIOR) + 2)
    for k in set(kinds):
        x[_COLUMN[k]] = 1
        x[len(PRIOR) + _COLUMN[k]] = math.log2(kinds.count(k))
    x[-2] = math.log2(max(1, size)) if kinds else 0
    x[-1] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights of rows x with labels y, n times each, by Newton steps; RIDGE pulls them to the prior."""
    start = prior()
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - RIDGE * (w - start)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _uses(text: str) -> set[tuple[str, str]]:
    """Words of three letters or more, each with the word before it."""
    seq = _WORD.findall(text.lower())
    return {(w, before) for before, w in zip(["", *seq], seq, strict=False) if len(w) > 2}


def _beside(model: Model, text: str) -> set[tuple[str, str, str]]:
    """side (``b`` before, ``a`` after), word and surroundings, for the words that stand beside a possible or certain insult in its clause."""
    out = set()
    tokens = _TOKEN.findall(text.lower())
    if not any(model.symbol(x) in (INSULT, WEAK) for x in set(tokens) if x not in _ENDS):
        return out
    for i, w in enumerate(tokens):
        if w in _ENDS or model.symbol(w) not in (INSULT, WEAK):
            continue
        around = " ".join(tokens[max(0, i - BESIDE - 1) : i + BESIDE + 2])
        for side, step in (("b", -1), ("a", 1)):
            for j in range(i + step, i + (BESIDE + 1) * step, step):
                if not 0 <= j < len(tokens) or tokens[j] in _ENDS:
                    break
                if model.symbol(tokens[j]) == OTHER:
                    out.add((side, tokens[j], around))
    return out


def lexicon(toxic: dict[str, int], share: dict[str, float]) -> tuple[set[str], set[str]]:
    """Insults and possible insults from chosen features: their numbers of toxic uses and shares of toxic ones.  Insults have a share of ``CERTAIN``."""

    def family(picked: dict[str, int]) -> set[str]:
        # of beginnings with nearly the same uses, the longest says what the words have in common
        stems = {f[1:] for f in picked if f[0] == "p"}
        whole = {f[1:] for f in picked if f[0] == "w"}
        longer = lambda s: (picked[k + t] for k, names in (("p", stems), ("w", whole)) for t in names if t.startswith(s) and k + t != "p" + s)
        closed = {s for s in stems if not any(k >= 0.9 * picked["p" + s] for k in longer(s))}
        closed = {s for s in closed if not any(s[:n] in closed for n in range(1, len(s)))}
        return {"w" + w for w in whole if not any(w[:n] in closed for n in range(1, len(w)))} | {"p" + s for s in closed}

    return family({f: toxic[f] for f, x in share.items() if x >= CERTAIN}), family({f: toxic[f] for f, x in share.items() if x < CERTAIN})


def _beyond_chance(counted: DataFrame, base: float, tests: int) -> DataFrame:
    """counted (n1, n0): rows whose share of toxic uses differs from ``base`` beyond chance, corrected for the number of tests (likelihood ratio)."""
    n = F.col("n1") + F.col("n0")
    part = lambda k, b: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (n * b))).otherwise(0.0)
    return counted.filter(2 * (part("n1", base) + part("n0", 1 - base)) >= 2 * math.log(max(tests, 1) / 0.05))


def word_classes(sides: DataFrame) -> tuple[set[str], set[str]]:
    """Targets and softeners from ``side, word, n1, n0``, the numbers of different toxic and clean surroundings of that word beside an insult: words whose share
    of toxic ones is beyond chance above that of all, or, before the insult, half of it or less."""
    total = sides.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.lit(1)).alias("tests")).first()
    if not total["n1"] or not total["n0"]:
        return set(), set()
    base = total["n1"] / (total["n1"] + total["n0"])
    sure = _beyond_chance(sides, base, total["tests"]).collect()  # of a bounded sample
    share = lambda r: r["n1"] / (r["n1"] + r["n0"])
    return {r["word"] for r in sure if share(r) > base}, {r["word"] for r in sure if r["side"] == "b" and share(r) <= base / 2}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    spark = kernels.session(docs)
    known = labels.filter(~held_out(label_id)).filter(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    known = known.groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    known = known.filter(spread < SAMPLE / max(n, 1))  # about SAMPLE rows, so it can be sent to every task
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    chosen = kernels.cut(rows.join(F.broadcast(known), "id"))
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()

    def per_label(task, width: int) -> DataFrame:
        """What the task finds in each text, once for each slice, label and thing: ``f1, f2, ..., toxic``."""
        names = [f"f{i}" for i in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in kernels.slices(batches):
                found = {(*x, label) for t, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for x in task(t)}
                cols = [pa.array([x[i] for x in found], pa.string()) for i in range(width)] + [pa.array([x[width] for x in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "toxic"])

        return chosen.mapInArrow(run, ", ".join(f"{x} string" for x in names) + ", toxic int").distinct()

    # words first; beginnings are sums over the words that have them
    words = per_label(_uses, 2).groupBy("f0").agg(*[F.sum((F.col("toxic") == x).cast("long")).alias(f"n{x}") for x in (1, 0)])
    starts = [F.when(F.length("f0") > k, F.concat(F.lit("p"), F.substring("f0", 1, k))) for k in PREFIXES]
    seen = words.select(F.explode(F.array_compact(F.array(F.concat(F.lit("w"), F.col("f0")), *starts))).alias("f"), "n1", "n0")
    seen = kernels.cut(seen.groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter(F.col("n1") >= LEAST_CONTEXTS))
    chosen_features = _beyond_chance(seen.filter(F.col("n1") >= PRECISION * (F.col("n1") + F.col("n0"))), n_toxic / (n_toxic + n_clean), seen.count()).collect()
    insults, possible = lexicon({r["f"]: r["n1"] for r in chosen_features}, {r["f"]: r["n1"] / (r["n1"] + r["n0"]) for r in chosen_features})
    model = Model(insults, possible)
    held = spark.sparkContext.broadcast(model)
    sides = per_label(lambda t: _beside(held.value, t), 3).groupBy("f0", "f1").agg(*[F.sum((F.col("toxic") == x).cast("long")).alias(f"n{x}") for x in (1, 0)])
    sides = kernels.cut(sides.filter(F.col("n1") + F.col("n0") >= LEAST_CONTEXTS).withColumnsRenamed({"f0": "side", "f1": "word"}))
    targets, softeners = word_classes(sides)
    model = Model(insults, possible, targets, softeners)
    again = spark.sparkContext.broadcast(model)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches):
            got = [again.value.read(t) for t in b.column(1).to_pylist()]
            k = ["".join(sorted(x)) for x, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([s for _, s in got], pa.int64()), b.column(2)], names=["k", "size", "toxic"])

    got = chosen.mapInArrow(kinds, "k string, size long, toxic int").groupBy("k", "size", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("k", "size", "toxic").collect()
    x = np.stack([features(r["k"], r["size"]) for r in got])
    model.weights = fit(x, np.array([r["toxic"] for r in got], float), np.array([r["n"] for r in got], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, clauses`` (the kinds of matched clauses) for each row."""
    spark = kernels.session(docs)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in kernels.slices(batches):
            got = [m.read(x or "") for x in b.column(1).to_pylist()]
            value, kinds = [m.weigh(*x) for x in got], [k for k, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(value, pa.float64()), pa.array(kinds, pa.string())], names=["id", "held_out", "score", "clauses"])

    return src.mapInArrow(run, "id long, held_out boolean, score double, clauses string")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without rows of that score or more; rows pass through whole and are not shuffled."""
    spark = kernels.session(docs)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.slices(batches, at):
            yield b.filter(pa.array([shared.value.score(x) < threshold for x in b.column(at).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
