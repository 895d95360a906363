"""The contract queries ``opN_<name>`` of this subpackage and their SQL.

Each query applies its operator, with the parameters it would have in
production, to its whole table and derives the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, hardneg, langid, mixing, quality, sharding, simhash, substring, tokencount, topk, toxicity, trie, urlfilter

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed_bits").bitwiseAND(quality.BASE.mask) != 0
    return led.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed_bits", "policy_version", "n_lines", "n_upper", "n_marks", "n_letters", "n_stutters",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select("doc_id", "shard_id", "shard_depth", "shard_bytes")


TOKEN_LIMIT = 512


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokencount.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=TOKEN_LIMIT)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).withColumnRenamed("id", "doc_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


MIX = mixing.Targets(domain={"d0": 40, "d1": 20, "d2": 20, "d3": 20}, lang={"en": 40, "de": 20, "fr": 20, "es": 20})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX).withColumnRenamed("id", "doc_id")


HOST_RULES = (
    urlfilter.HostRule("net", "/", "block"),
    urlfilter.HostRule("example.net", "/en/", "allow"),
    urlfilter.HostRule("example.com", "/de/", "block"),
    urlfilter.HostRule("org", "/fr/", "allow"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES).withColumnRenamed("id", "page_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "clauses")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, scale=1024, k=10)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("id") % 100 == 0, scale=256, n_positives=5, k=10, window=(30, 90))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, positive_rank,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE positive_rank <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, positive_rank::INT AS positive_rank FROM n WHERE rank <= 10
"""

def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(*trie.grafted(trie.turns(_table(spark, sf_dir, "conversations")), every=20, spread=4))


# crc32 as a table of 256 remainders, made in eight steps, and a fold over the digits of the id
OP13_SQL = rf"""
WITH RECURSIVE steps(n, c, k) AS (
  SELECT n, n, 0 FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8
), own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, l, xor(list_reduce([4294967295::BIGINT] || [ascii(ch)::BIGINT FOR ch IN string_split(conv_id::VARCHAR, '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc
), c AS (
  SELECT h.conv_id, coalesce(b.l[:h.h], []) || h.l[h.h + 1:] AS l FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20
), p AS (
  SELECT conv_id, len(l) AS len, d AS depth, md5(l[:d]::VARCHAR || d) AS node, CASE WHEN d > 0 THEN md5(l[:d - 1]::VARCHAR || (d - 1)) END AS parent,
    CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].text, '{WORD}')) ELSE 0 END AS words, [md5(l[:k]::VARCHAR || k) FOR k IN range(0, d + 1)] AS above
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM c)
), n AS (
  SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(above) AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM p GROUP BY ALL
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent
), below AS (
  SELECT a AS node, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM (SELECT n.*, n_children, unnest(above) AS a FROM n LEFT JOIN kids USING (node)) GROUP BY a
)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n m ON m.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN below ON below.node = n.node
"""

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM win WHERE n > 1) GROUP BY doc_id
), stut AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d WHERE len(w) >= 2) WHERE w[i] = w[i - 1] GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks,
    length(regexp_replace(text, '\P{{L}}', '', 'g'))::BIGINT AS n_letters,
    coalesce(stut.n, 0)::BIGINT AS n_stutters
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN stut USING (doc_id)
), b AS (
  SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in quality.RULES.items())})::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {quality.BASE.mask}) <> 0 AS base_failed,
  (failed_bits & {quality.STANDARD.mask | quality.BASE.mask}) = 0 AS kept, failed_bits, '{quality.STANDARD.version}' AS policy_version, n_lines, n_upper, n_marks, n_letters, n_stutters
FROM b
"""

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) + {sharding.ROW_BYTES} AS b FROM documents
), tree AS (
  SELECT depth, h >> (60 - depth) AS p, sum(b)::BIGINT AS bytes FROM d, range(0, 41) t(depth) GROUP BY ALL
), shard AS (
  SELECT t.depth, t.p, t.bytes FROM tree t LEFT JOIN tree u ON u.depth = t.depth - 1 AND u.p = t.p >> 1
  WHERE t.bytes <= {SHARD_BYTES} AND (t.depth = 0 OR u.bytes > {SHARD_BYTES})
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth::INT, '0') END AS shard_id, depth::INT AS shard_depth, bytes AS shard_bytes
FROM d JOIN shard ON h >> (60 - depth) = p
"""


def _weights(level: str) -> str:
    return "CASE " + "".join(f"WHEN {level} = '{k}' THEN {v} " for k, v in getattr(MIX, level).items()) + f"WHEN true THEN {MIX.default} END"


def _share_sql(name: str, parent: str, source: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    on = f"{parent}, " if parent else ""
    back = f"USING ({parent})" if parent else "ON true"
    return f"""
{name}_a AS (
  SELECT *, budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_left,
    sum(weight) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM (SELECT {on}{name}, sum(cap)::BIGINT AS cap, {_weights(name)} AS weight FROM leaf GROUP BY ALL) JOIN {source} {back}
), {name}_b AS (
  SELECT {on}arg_min({{'l': rest_left, 'w': w_left}}, rest_left) AS stop FROM (
    SELECT *, row_number() OVER ({by} ORDER BY cap / weight, {name}) AS rn FROM {name}_a WHERE cap * w_left > weight * rest_left) WHERE rn = 1 {f"GROUP BY {parent}" if parent else ""}
), {name}_c AS (
  SELECT {on}{name}, (CASE WHEN cap * w_left <= weight * rest_left THEN cap ELSE stop.l * weight // stop.w END)::BIGINT AS budget
  FROM {name}_a LEFT JOIN {name}_b {back}
)"""


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) // 5), '?') AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens, (sum(n_tokens) * {MIX.max_epochs})::BIGINT AS cap FROM d GROUP BY ALL
), top AS (
  SELECT least(floor(sum(leaf_tokens) * {MIX.budget_pct} / 100), sum(cap))::BIGINT AS budget FROM leaf
), {_share_sql("domain", "", "top")}, {_share_sql("lang", "domain", "domain_c")}, {_share_sql("source", "domain, lang", "lang_c")}, plan AS (
  SELECT *, coalesce(budget // nullif(leaf_tokens, 0), 0) AS whole_epochs FROM leaf JOIN source_c USING (domain, lang, source)
), ranked AS (
  SELECT d.*, whole_epochs, budget - whole_epochs * leaf_tokens AS rest,
    md5('{MIX.seed}:' || (whole_epochs + 1)::VARCHAR || ':' || doc_id::VARCHAR) AS h FROM d JOIN plan USING (domain, lang, source)
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(h, 1, 15), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
)
SELECT doc_id, domain, lang, source, n_tokens, (whole_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies, whole_epochs::BIGINT AS whole_epochs
FROM run WHERE whole_epochs > 0 OR upto <= rest
"""

_RULES_SQL = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.action}')" for r in HOST_RULES)
_BLOCKED_SQL = " OR ".join(f"regexp_matches(low, '{p.format('(?:' + '|'.join(urlfilter.UNWANTED) + ')')}')" for p in urlfilter.PLACES)
OP9_SQL = f"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), hit AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(action, length(name)) AS action
  FROM p JOIN (VALUES {_RULES_SQL}) r(name, rule_host, rule_path, action) ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {_BLOCKED_SQL} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit USING (page_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_topk": op11_topk,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {"op1_sharding": OP1_SQL, "op2_quality_rules": OP2_SQL, "op7_mixing": OP7_SQL, "op9_url_filter": OP9_SQL, "op11_topk": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
