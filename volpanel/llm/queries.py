"""Registered queries of the operators, each over its whole table, with oracle SQL where SQL can tell the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm import (
    exact_dedup,
    language_id,
    license_scan,
    merkle,
    mixing,
    ngram_join,
    packing,
    simhash,
    spelling,
    token_files,
    url_rules,
    vector_graph,
    warc,
)
from volpanel.llm.license_texts import TEMPLATES
from volpanel.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The stated URL rules, host and path to verdict.
STATED_RULES = {
    ("net", "/"): "block",
    ("example.net", "/en/"): "allow",
    ("example.com", "/de/"): "block",
    ("org", "/fr/"): "allow",
}
URL_LEAST, URL_SHARE, URL_LIFT = 4, 0.001, 1.5


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a label: the last number in a page's path names its document; bad or toxic ones are blocked."""
    doc = F.regexp_extract(url_rules.path_of(F.col("url")), r"/(\d+)[^/]*$", 1)
    pages = table(spark, sf_dir, "pages").select("url", doc.try_cast("bigint").alias("doc_id"))
    labels = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    )
    return pages.join(labels, "doc_id").select("url", "blocked")


URL_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for (h, p), v in STATED_RULES.items())}),
base AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
tokens AS (
  SELECT page_id, url, host, path, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(list_concat(
    ['host=' || host,
     'site=' || nullif(regexp_extract(host, '([^.]+\\.[^.]+)$', 1), ''),
     'ext=' || nullif(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1), ''),
     'frag=' || nullif(regexp_extract(url, '(?s)#(.*)$', 1), '')],
    list_concat(
      list_transform(list_filter(string_split(host, '.')[1:greatest(len(string_split(host, '.')) - 2, 0)], lambda s: s <> ''),
        lambda s: 'label=' || s),
      list_transform(list_filter(string_split(path, '/'), lambda s: regexp_full_match(s, '[A-Za-z_-]+')), lambda s: 'path=' || s),
      list_transform(list_filter(string_split(regexp_extract(url, '(?s)\\?([^#]*)', 1), '&'), lambda s: s <> ''),
        lambda s: 'query=' || regexp_extract(s, '^([^=]*)', 1)))), lambda t: t IS NOT NULL))) END AS tokens
  FROM base),
bad AS (SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS blocked FROM labels GROUP BY doc_id),
train AS (
  SELECT tokens, blocked FROM tokens
  JOIN bad ON bad.doc_id = try_cast(nullif(regexp_extract(path, '/(\\d+)[^/]*$', 1), '') AS BIGINT)
  WHERE blocked IS NOT NULL),
masks AS (SELECT tokens, blocked, unnest(range(1, 1 << len(tokens))) AS mask FROM train WHERE len(tokens) > 0),
subsets AS (
  SELECT list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS antecedent, blocked FROM masks),
counted AS (
  SELECT antecedent, count(*) AS n, count(*) FILTER (WHERE blocked) AS n_bad FROM subsets GROUP BY antecedent),
mined AS (
  SELECT antecedent, array_to_string(antecedent, ' & ') AS pattern, n_bad / n AS confidence, n_bad
  FROM counted, (SELECT count(*) AS total, count(*) FILTER (WHERE blocked) AS bad FROM train)
  WHERE n_bad >= greatest({URL_LEAST}, ceil({URL_SHARE}e0 * total)) AND n_bad / n >= least(1e0, {URL_LIFT}e0 * bad / total)),
sets AS (SELECT DISTINCT tokens FROM tokens),
best AS (
  SELECT s.tokens, first(m.pattern ORDER BY m.confidence DESC, m.n_bad DESC, m.pattern) AS pattern
  FROM sets s JOIN mined m ON list_has_all(s.tokens, m.antecedent) GROUP BY s.tokens),
stated AS (
  SELECT page_id, first(r.host || r.path ORDER BY len(r.host || r.path) DESC) AS rule,
    first(r.verdict ORDER BY len(r.host || r.path) DESC) AS verdict
  FROM base b JOIN rules r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path)
  GROUP BY page_id)
SELECT t.page_id, t.host, t.path, s.rule,
  coalesce(s.verdict, CASE WHEN best.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, best.pattern
FROM tokens t LEFT JOIN stated s USING (page_id) LEFT JOIN best ON best.tokens = t.tokens
"""


@register("op1_url_rules", URL_SQL)
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(
        table(spark, sf_dir, "pages"),
        page_labels(spark, sf_dir),
        STATED_RULES,
        least=URL_LEAST,
        least_share=URL_SHARE,
        lift=URL_LIFT,
    )


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS spot
  FROM documents),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source),
whole AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t, count(*) AS n FROM totals),
shares AS (SELECT totals.*, tokens / t AS share, t AS budget, n FROM totals, whole),
grid AS (
  SELECT k, sum(share ** (k / 10000)) AS z, sum(share ** (k / 10000) * ln(share)) AS s,
    max(share ** (k / 10000) / tokens) AS r, any_value(budget) AS budget, any_value(n) AS n
  FROM shares, range(0, 10001) AS g(k) GROUP BY k),
tested AS (
  SELECT k, ln(z) - (k / 10000) * s / z >= 0.95e0 * ln(n) - 1e-12 AS flat, budget * r / z <= 4.0e0 + 1e-12 AS fits FROM grid),
step AS (SELECT greatest((SELECT max(k) FROM tested WHERE flat), (SELECT min(k) FROM tested WHERE fits)) / 10000 AS a),
norm AS (SELECT sum(share ** a) AS z, any_value(a) AS a FROM shares, step),
plan AS (
  SELECT source, tokens, a, CAST(floor(budget * (share ** a / z) * (1.0e0 + 1e-12)) AS BIGINT) AS quota,
    least(greatest(0, CAST(ceil(log2(docs / 1000.0e0)) AS INT)), 24) AS bits
  FROM shares, norm),
placed AS (
  SELECT d.*, p.a, quota // tokens AS passes, quota % tokens AS rest,
    CAST(floor(spot * (1::BIGINT << bits) / 4294967296) AS BIGINT) AS block
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
blocks AS (
  SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS bt, any_value(passes) AS passes, any_value(rest) AS rest
  FROM placed GROUP BY source, block),
visits AS (
  SELECT source, block, epoch, row_number() OVER w AS block_rank, sum(bt) OVER w - bt AS before, passes, rest
  FROM (SELECT *, unnest(range(0, passes + 1)) AS epoch FROM blocks)
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('17:' || epoch || ':' || block), block
    ROWS UNBOUNDED PRECEDING)),
drawn AS (
  SELECT p.doc_id, p.source, p.n_tokens, p.a, v.epoch, v.block_rank,
    row_number() OVER w AS slot, sum(n_tokens) OVER w AS used,
    CASE WHEN v.epoch = v.passes THEN v.rest - v.before END AS quota_left
  FROM placed p JOIN visits v ON p.source IS NOT DISTINCT FROM v.source AND p.block = v.block
  WHERE v.epoch < v.passes OR v.rest - v.before > 0
  WINDOW w AS (PARTITION BY p.source, v.epoch, v.block
    ORDER BY md5('17:' || v.epoch || ':' || coalesce(CAST(p.doc_id AS VARCHAR), '')), n_tokens ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, n_tokens, epoch, CAST(block_rank AS INT) AS block_rank, CAST(slot AS INT) AS slot, a AS exponent
FROM drawn WHERE quota_left IS NULL OR used <= quota_left
"""


@register("op10_temperature_mix", MIX_SQL)
def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.temperature_mixture(table(spark, sf_dir, "documents"))


@register(
    "op4_exact_dedup",
    """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of their id, are the stored snapshot; the others come in as a batch."""
    stored = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), stored).drop("was_stored")


@register(
    "op8_warc_revisits",
    """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS body
  FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM r
""",
)
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@register("op9_variable_packing")
def op9_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


NGRAM_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
      WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)
      AS shingle
    FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS seen FROM both_ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.seen)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


@register("op6_ngram_join", NGRAM_SQL)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"), join=ngram_join.Join(words=3, num=90, den=100))


@register("op7_vector_graph")
def op7_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the names of its license notices in text order, their places and coverage."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES)


@register("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op11_simhash_bytes")
def op11_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, of which ``hex(encode(...))`` tells two digits each."""
    bytes_ = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    start = "4294967295::BIGINT"
    # One entry of the table per step: eight shifts of the lowest byte.
    return (
        f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, crc_table[CAST(xor(a & 255, b) AS INT) + 1]), {start}), {start})"
    )


#: The table of crc32, by its rule.
CRC_TABLE_SQL = """crc AS (
  SELECT list(v ORDER BY b) AS crc_table FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v
    FROM range(256) AS g(b)))"""

SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS c FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, c, {_crc32_sql("named")} AS h FROM each, crc),
damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % len(run) AS INT)) || substr(run, CAST(h % len(run) AS INT) + 2) ELSE run END AS word, c
  FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, CAST(unnest(range(len(word))) AS INT) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION
  SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form,
    CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS reached, 0 AS steps FROM formed
  UNION ALL
  SELECT walk.word, f.form, steps + 1 FROM walk JOIN formed f ON f.word = walk.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, last(reached ORDER BY steps) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""


@register("op12_spelling_variants", SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _tree_sql(leaves: str, prefix: str, key: str, levels: int) -> tuple[str, str]:
    """Common tables of a tree over ``leaves`` (key, pos, h): nodes and siblings per level; the name of the last level's nodes."""
    sql, nodes = "", leaves
    for level in range(levels):
        sql += f"""
{prefix}s{level} AS (
  SELECT {key}, pos, h, pos // 3 AS up, count(*) OVER (PARTITION BY {key}) AS n,
    coalesce(string_agg(h, '') OVER (PARTITION BY {key}, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY {key}, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {nodes}),
{prefix}{level + 1} AS (
  SELECT {key}, up AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
  FROM {prefix}s{level} GROUP BY {key}, up),"""
        nodes = f"{prefix}{level + 1}"
    return sql, nodes


def _merkle_sql(levels: int, top_levels: int) -> str:
    def field(name: str, value: str | None = None) -> str:
        value = value or f"CAST({name} AS VARCHAR)"
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    before = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower, subroots = _tree_sql("leaves", "a", "source", levels)
    upper, roots = _tree_sql("ranked", "b", "k", top_levels)
    joins, proof, fold = "", "''", "start"
    for level in range(levels):
        at = f"x{level}"
        joins += f" JOIN as{level} {at} ON {at}.source IS NOT DISTINCT FROM d.source AND {at}.pos = d.pos // {3**level}"
        proof += f" || CASE WHEN {at}.n > 1 THEN {at}.l || {at}.r ELSE '' END"
        fold = f"CASE WHEN {at}.n > 1 THEN sha256({at}.l || {fold} || {at}.r) ELSE {fold} END"
    joins += " JOIN ranked q ON q.source IS NOT DISTINCT FROM d.source"
    for level in range(top_levels):
        at = f"y{level}"
        joins += f" JOIN bs{level} {at} ON {at}.pos = q.pos // {3**level}"
        proof += f" || CASE WHEN {at}.n > 1 THEN {at}.l || {at}.r ELSE '' END"
        fold = f"CASE WHEN {at}.n > 1 THEN sha256({at}.l || {fold} || {at}.r) ELSE {fold} END"
    return f"""
WITH {CRC_TABLE_SQL},
hashed AS (
  SELECT doc_id, source, sha256({before} || {field("text")}) AS h,
    sha256({before} || {field("text", "CASE WHEN " + _crc32_sql("CAST(doc_id AS VARCHAR)") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS start
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM hashed),{lower}
ranked AS (SELECT 0 AS k, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h FROM {subroots}),{upper}
folded AS (
  SELECT d.doc_id, d.h AS leaf, q.h AS subroot, t.h AS root, sha256({proof}) AS proof_sha256, {fold} AS folded_root
  FROM leaves d{joins} JOIN {roots} t ON true)
SELECT *, folded_root = root AS verified FROM folded
"""


@register("op13_merkle_manifest", _merkle_sql(levels=8, top_levels=3))
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by their id's crc32, arrive with the line breaks of their text deleted."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    received = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), received={"text": received}).drop("path")
