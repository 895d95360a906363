"""Token counts by prefix dynamic programming.

For byte-pair encoding, the last token of each prefix's own encoding is the only
token that ends there and may stand after the last token of the prefix before it.
So one pass over a piece gives, for every prefix, its last token and its token
count, without encoding any prefix again.  Pieces are the pre-tokenizer's; a document's
counts are running sums over its pieces, corrected where a prefix ends inside white space
or a contraction, whose pieces depend on what follows.

``counts`` gives totals; with a ``budget`` also the longest prefix that fits it, from the sums over pieces and the prefixes
around the one where the budget ends; with ``store=True`` the count at every prefix (one
entry for each code point, the first for the empty prefix), from which
``tokens_at`` and ``fits`` answer truncation and budget questions in plain SQL.

The special strings of the tokenizer file count as one token inside texts, as the
library does by default.  Defined cases: a null text is empty and has no tokens; repeated
rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACE = regex.compile(r"\s")
#: Pieces and token pairs remembered by a worker.
CACHE = 1_000_000


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: The same pattern for ``re``, right for texts of nothing but PLAIN characters, and faster.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\t-\r -~\u00c0-\u024f\u2010-\u2027]")


def pieces(text: str) -> list[str]:
    return (PATTERN if _NOT_PLAIN.search(text) else _FAST).findall(text)


class Counter(dict):
    """piece -> token count, filled by the prefix programme; use ``prefixes`` for all of a piece's counts."""

    def __init__(self, file: bytes):
        super().__init__()
        spec = json.loads(file)
        letters = byte_letters()
        real = lambda s: bytes(letters[c] for c in s)
        added = [t["content"] for t in spec["added_tokens"]]
        self.tokens = [real(t) for t in spec["model"]["vocab"] if t not in added]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(real(a), real(b)): i for i, (a, b) in enumerate(merges)}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pairs: dict[int, bool] = {}
        self.start = len(self.tokens)
        # tokens read backwards: (node, byte) -> node, and the token that ends at a node
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for number, t in enumerate(self.tokens):
            node = 0
            for x in reversed(t):
                key = node << 8 | x
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.step[key]
            self.ends[node] = number

    def merge(self, word: bytes) -> list[bytes]:
        """Byte-pair encoding of a short word by its definition."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.rank
        while len(parts) > 1:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, key: int) -> bool:
        """Whether an encoding may have a token right after another (or the start), as ``first << 20 | second``."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        a, b = key >> 20, self.tokens[key & 0xFFFFF]
        found = self.merge(b) == [b] if a == self.start else self.merge(self.tokens[a] + b) == [self.tokens[a], b]
        self.pairs[key] = found
        return found

    def extend(self, piece: bytes, known: int, last: list[int], count: list[int]) -> None:
        """The programme: last token and count of each prefix, from the first ``known`` bytes on."""
        del last[known + 1 :], count[known + 1 :]
        step, ends, pairs = self.step, self.ends, self.pairs
        for e in range(known + 1, len(piece) + 1):
            node, j = 0, e
            while True:
                j -= 1
                node = step[node << 8 | piece[j]]
                t = ends[node]
                if t >= 0:
                    key = last[j] << 20 | t
                    ok = pairs.get(key)
                    if self.follows(key) if ok is None else ok:
                        last.append(t)
                        count.append(count[j] + 1)
                        break

    def prefixes(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one piece."""
        last, count = [self.start], [0]
        self.extend(piece, 0, last, count)
        return count

    def learn(self, new: set[str]) -> None:
        """Counts of new pieces; in sorted order, each goes on from the prefix that it shares with the one before."""
        if len(self) + len(new) > CACHE:
            self.clear()
        last, count, before = [self.start], [0], b""
        for piece in sorted(new):
            b = piece.encode("utf-8", "surrogatepass")
            known = len(commonprefix((before, b)))
            self.extend(b, known, last, count)
            self[piece], before = count[-1], b

    def __missing__(self, piece: str) -> int:
        self.learn({piece})
        return self[piece]

    def totals(self, texts: list[str]) -> list[int]:
        parts = [self.segments(x) for x in texts]
        found = [[q for p in x for q in pieces(p)] for x in parts]
        self.learn({q for x in found for q in x if q not in self})
        return [len(x) - 1 + sum(map(self.__getitem__, y)) for x, y in zip(parts, found, strict=True)]

    def fit(self, text: str, budget: int) -> int:
        """The most leading code points whose encoding has no more than ``budget`` tokens.

        Running sums over whole pieces find the piece in which the budget ends; only the prefixes around it are looked at one by one.
        """
        if self.special and self.special.search(text):
            return max(k for k, n in enumerate(self.every_prefix(text)) if n <= budget)
        found = pieces(text)
        self.learn({q for q in found if q not in self})
        total, at = [0], [0]
        for q in found:
            total.append(total[-1] + self[q])
            at.append(at[-1] + len(q))
        if total[-1] <= budget:
            return len(text)
        over = bisect_right(total, budget)  # the first piece boundary beyond the budget
        low = over - 1
        while low and _SPACE.match(text[at[low] - 1]):  # a prefix that ends in white space is cut from the run's begin
            low -= 1
        high = over
        while high < len(found) and (total[high] <= budget + 2 or _SPACE.match(text[at[high] - 1])):
            high += 1
        some = self.every_prefix(text[at[low] : at[high]])
        return max(at[low] + k for k, n in enumerate(some) if total[low] + n <= budget)

    def segments(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def every_prefix(self, text: str) -> list[int]:
        """Token count of every code-point prefix of a text."""
        out, base, at = [0], 0, 0
        marks = [*(m.span() for m in self.special.finditer(text))] if self.special else []
        for begin, stop in [*marks, (len(text), len(text))]:
            base, tail, tail_base = self._segment(text, at, begin, base, out)
            for k in range(begin + 1, stop + 1):  # inside a special string it is ordinary text still
                out.append(base + 1 if k == stop else tail_base + sum(self[p] for p in PATTERN.findall(text[tail:k])))
            base += stop > begin
            at = stop
        return out

    def _segment(self, text: str, start: int, stop: int, base: int, out: list[int]) -> tuple[int, int, int]:
        """Appends the counts of prefixes that end in text[start:stop]; the new base, and the last piece's start and its base."""
        tail, tail_base = start, base
        run, run_base = -1, base  # the white space before the prefix's end
        for m in PATTERN.finditer(text, start, stop):
            s, e = m.span()
            piece = m.group()
            inner = self.prefixes(piece.encode("utf-8", "surrogatepass"))
            tail, tail_base = (s, base) if run < 0 else (run, run_base)
            offset = 0
            for k in range(s + 1, e + 1):
                c = text[k - 1]
                offset += len(c.encode("utf-8", "surrogatepass"))
                if _SPACE.match(c):
                    if run < 0:
                        run, run_base = k - 1, out[k - 1]
                    out.append(run_base + self[text[run:k]])
                    continue
                run = -1
                split = piece[0] == "'" and 1 < k - s < len(piece)
                out.append(base + (sum(self[p] for p in PATTERN.findall(piece[: k - s])) if split else inner[offset]))
            base += inner[-1]
        return base, tail, tail_base


_COUNTERS: dict[bytes, Counter] = {}


def counter(file: bytes) -> Counter:
    """The worker's counter for a tokenizer file's bytes; its memory of pieces serves all its tasks."""
    key = hashlib.sha256(file).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(file)
    return _COUNTERS[key]


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", store: bool = False, budget: int | None = None) -> DataFrame:
    """``id, n_bytes, n_tokens`` for each row; ``upto`` (array<int>) with ``store``, and with ``budget`` ``fit_chars``: the most leading code
    points whose encoding has no more tokens than that.  The file is read here and sent to the workers."""
    spark = kernels.session(docs)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_bytes", "n_tokens", *["upto"] * store, *["fit_chars"] * (budget is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for b in kernels.slices(batches):
            c = c or counter(shared.value)
            texts = [x or "" for x in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array(kernels.text_sizes(b.column(1)))]
            upto = [c.every_prefix(x) for x in texts] if store else []
            total = [x[-1] for x in upto] if store else c.totals(texts)
            cols.append(pa.array(total, pa.int64()))
            if store:
                cols.append(pa.array(upto, pa.list_(pa.int32())))
            if budget is not None:
                cols.append(pa.array([len(x) if n <= budget else c.fit(x, budget) for x, n in zip(texts, total, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, "id long, n_bytes long, n_tokens long" + ", upto array<int>" * store + ", fit_chars long" * (budget is not None))


def tokens_at(upto: Column, n_chars: Column) -> Column:
    """Tokens of a text's first n_chars code points (all, if it has fewer)."""
    return F.element_at(upto, F.least(n_chars, F.size(upto) - 1).cast("int") + 1)


def fits(upto: Column, budget: int) -> Column:
    """The most leading code points whose encoding has no more than ``budget`` tokens."""
    return F.array_max(F.filter(F.transform(upto, lambda x, i: F.when(x <= budget, i)), lambda x: x.isNotNull()))
