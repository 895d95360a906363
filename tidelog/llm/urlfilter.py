"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a host suffix with a path prefix, or a regular expression over the whole URL.  The tokens that
a URL must hold for a pattern to fit (whole runs of ASCII letters or digits) are read off the parsed expression:
``demands`` spells its alternatives, options and small sets out, and gives the whole tokens of each spelling.  A rule is
filed, for each spelling, under the one that is rarest in the URLs at hand; token counts come from one aggregation
over all URLs, restricted to the rules' own tokens.  A URL's tokens fetch candidate rules, and only
candidates run their test.  A pattern with a spelling that demands no whole token cannot be indexed and is refused.

The rule set is configuration, not corpus: it is broadcast to the workers in blocks
of at most ``BLOCK_RULES`` rules, one pass over the URLs for each block.

Defined cases: a null URL, or one without ``://``, has empty host and path and
fits no host rule; repeated rows are judged each; an empty table gives an empty
result; with no rule found the verdict is ``allow``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre  # the parsed form of a pattern has no public name
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels

BLOCK_RULES = 100_000
#: Spellings of one pattern at most; beyond, an alternative is taken as anything at all.
SPELLINGS = 512
_TOKEN = re.compile(r"[a-z0-9]+")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``; the longest fitting rule decides."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def demands(self) -> list[frozenset[str]]:
        """Whole tokens of every URL it fits: the host's, and the path's but for an open last one."""
        path = self.path.translate(_FOLD)
        closed = [m.group() for m in _TOKEN.finditer(path) if m.end() < len(path)]
        return [frozenset(_TOKEN.findall(self.host.translate(_FOLD)) + closed)]


#: Pieces of a spelling besides letters and digits: something that is surely no part of a token, and anything or nothing.
EDGE, ANY = "|", "*"


def _joined(parts: list[list[str]]) -> list[str]:
    """Spellings of a sequence from those of its pieces; too many of them become ANY."""
    out = [""]
    for piece in parts:
        out = [a + b for a in out for b in piece] if len(out) * len(piece) <= SPELLINGS else [a + ANY for a in out]
    return list(dict.fromkeys(out))


def _spelled(node) -> list[str]:
    """Spellings of a parsed pattern."""
    return _joined([_one(op, arg) for op, arg in node])


def _set(items) -> list[str]:
    """Spellings of a set of characters."""
    if items and items[0][0] is sre.NEGATE:
        inside = {chr(x) for op, arg in items if op in (sre.LITERAL, sre.RANGE) for x in ([arg] if op is sre.LITERAL else range(arg[0], min(arg[1], 255) + 1))}
        return [EDGE] if inside >= _LETTERS else [ANY]
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg) if chr(arg) in _LETTERS else EDGE)
        elif op is sre.RANGE:
            out |= {chr(x) if chr(x) in _LETTERS else EDGE for x in range(arg[0], min(arg[1], arg[0] + 300) + 1)}
        elif op is sre.CATEGORY and arg is sre.CATEGORY_SPACE:
            out.add(EDGE)
        else:
            return [ANY]
    return sorted(out) if len(out) <= 4 else [ANY]


def _one(op, arg) -> list[str]:
    if op is sre.LITERAL:
        return [chr(arg) if chr(arg) in _LETTERS else EDGE]
    if op is sre.IN:
        return _set(arg)
    if op is sre.AT:
        # a word's boundary is none of a token where an underscore follows, so it is not taken for one
        return [EDGE] if arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING) else [""]
    if op is sre.SUBPATTERN:
        return _spelled(arg[-1])
    if op is sre.BRANCH:
        found = list(dict.fromkeys(s for x in arg[1] for s in _spelled(x)))
        return found if len(found) <= SPELLINGS else [ANY]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        inner = _spelled(sub)
        if high <= 2:
            return list(dict.fromkeys(s for n in range(low, high + 1) for s in _joined([inner] * n)))
        # before and behind what repeats stand its own ends
        return _joined([inner, [ANY], inner]) + (inner if low < 2 else []) + ([""] if low == 0 else [])
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return [""]
    return [ANY]


@lru_cache(maxsize=1 << 16)
def demands(pattern: str) -> tuple[frozenset[str], ...]:
    """For each spelling of the pattern, the whole tokens that every URL it fits must hold."""
    out = []
    for s in _spelled(_parser.parse(pattern)):
        found = frozenset(m.group(1) for m in re.finditer(r"(?<=\|)([a-z0-9]+)(?=\|)", ANY + s + ANY))
        if not found:
            raise ValueError(f"a URL may fit {pattern!r} without any whole token of it, so it cannot be indexed")
        out.append(found)
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class PatternRule:
    """Fits where ``pattern`` is found in the lower-cased URL."""

    pattern: str
    action: str = "block"

    def demands(self) -> tuple[frozenset[str], ...]:
        return demands(self.pattern)


#: Words of sites that are not wanted: gambling, adult, pills, advertising, spam and warez.
UNWANTED = (
    "bet bingo blackjack baccarat casino jackpot lottery lotto poker roulette slot sportsbook wager "
    "camgirl escort fetish hentai milf nude porn porno sex striptease webcam xxx "
    "cialis diazepam levitra modafinil pharma pill phentermine steroid tramadol viagra xanax "
    "ad adclick adserver advert affiliate banner clickbait doubleclick popunder popup retarget sponsor "
    "spam bulkmail followers giveaway linkfarm replica sweepstake "
    "crack keygen nulled torrent warez"
).split()
#: Where such a word must stand: as a host's label, at its begin, at its end, or as a segment of the path.
PLACES = (r"://(?:[^/?#]*\.)?{}s?\.", r"://(?:[^/?#]*\.)?{}s?-[a-z0-9-]+\.", r"://(?:[^/?#]*[.-])?[a-z0-9]+-{}s?\.", r"://[^/?#]*/(?:[^?#]*/)?{}s?(?:[/?#.]|$)")
DEFAULT_PATTERNS: tuple[PatternRule, ...] = tuple(PatternRule(place.format(w)) for w in UNWANTED for place in PLACES)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters lower-cased) and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[stop:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:stop].translate(_FOLD), tail[:end]


@lru_cache(maxsize=1 << 16)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


class Index:
    """Rules by rarest token.  Built on the driver, used by the workers, which compile the patterns that they meet."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[PatternRule], counts: dict[str, int]):
        self.by_token: dict[str, list[HostRule | PatternRule]] = defaultdict(list)
        for r in [*hosts, *patterns]:
            for token in sorted({min(x, key=lambda t: (counts.get(t, 0), t)) for x in r.demands()}):
                self.by_token[token].append(r)

    def candidates(self, low: str) -> list[HostRule | PatternRule]:
        """The rules that a lower-cased URL's tokens fetch."""
        return [r for t in set(_TOKEN.findall(low)) for r in self.by_token.get(t, ())]

    def judge(self, url: str | None) -> tuple[str, str, HostRule | None, str | None]:
        """Host, path, the longest fitting host rule, the pattern action (allow before block)."""
        host, path = split_url(url)
        low = (url or "").translate(_FOLD)
        best, action = None, None
        for r in self.candidates(low):
            if isinstance(r, HostRule):
                if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
                    if best is None or (len(r.name), r.name) > (len(best.name), best.name):
                        best = r
            elif action != "allow" and _compiled(r.pattern).search(low):
                action = r.action
        return host, path, best, action


def token_counts(urls: DataFrame, wanted: set[str], url_col: str = "url") -> dict[str, int]:
    """How many token places of all URLs hold each wanted token; as many rows as there are wanted tokens at most."""
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("([a-z0-9]+)"), 1)).alias("t"))
    names = urls.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "t string")  # a block's rules have them all
    return {r["t"]: r["n"] for r in tokens.join(F.broadcast(names), "t").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(urls: DataFrame, hosts: Sequence[HostRule] = (), patterns: Sequence[PatternRule] = DEFAULT_PATTERNS, id_col: str = "page_id", url_col: str = "url", block: int = BLOCK_RULES) -> DataFrame:
    """``id, host, path, rule, verdict`` for each row; a host rule decides before any pattern."""
    spark = kernels.session(urls)
    src = urls.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    schema = "id long, url string, host string, path string, rule string, rule_action string, pattern_action string"
    out = src.select("id", "url", *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "rule", "rule_action", "pattern_action")])
    rules = [*hosts, *patterns]
    for at in range(0, max(1, len(rules)), block):
        part = rules[at : at + block]
        wanted = {t for r in part for x in r.demands() for t in x}
        index = Index([r for r in part if isinstance(r, HostRule)], [r for r in part if isinstance(r, PatternRule)], token_counts(src, wanted))
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows = b.to_pydict()
                for i, url in enumerate(rows["url"]):
                    host, path, best, action = index.judge(url)
                    old = rows["rule"][i]
                    rows["host"][i], rows["path"][i] = host, path
                    if best is not None and (old is None or (len(best.name), best.name) > (len(old), old)):
                        rows["rule"][i], rows["rule_action"][i] = best.name, best.action
                    if rows["pattern_action"][i] != "allow":
                        rows["pattern_action"][i] = action or rows["pattern_action"][i]
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("url", "host", "path", "rule", "rule_action", "pattern_action"))]))

        out = out.mapInArrow(run, schema)
    return out.select("id", "host", "path", "rule", F.coalesce("rule_action", "pattern_action", F.lit("allow")).alias("verdict"))
