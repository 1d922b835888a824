"""One named query per operator, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_file())


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, places.k AS k, item FROM places JOIN windows ON places.k = windows.k AND places.win = windows.win),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN spans ON words.doc_id = spans.doc_id LEFT JOIN found ON words.doc_id = found.doc_id
"""


@query("op6_decontaminate", OP6_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.wumanber import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

_KEY_SQL = r"""CASE WHEN {host} != '' THEN regexp_replace({host}, '^www\.', '') || regexp_replace({path}, '/+$', '')
  || CASE WHEN {kept} != '' THEN '?' || {kept} ELSE '' END END"""


def _alias_sql(url: str) -> str:
    host = rf"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
    kept = rf"array_to_string(list_filter(string_split(regexp_extract(coalesce({url}, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: p != '' AND NOT starts_with(p, 'utm_')), '&')"
    return _KEY_SQL.format(host=host, path=path, kept=kept)


OP8_SQL = rf"""
WITH RECURSIVE parsed AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    {_alias_sql('url')} AS page FROM pages),
rules(action, site, prefix) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, url, arg_max(site || prefix, length(site || prefix)) AS rule, arg_max(action, length(site || prefix)) AS action
  FROM parsed JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix) GROUP BY page_id, url),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM pages
  WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'http-equiv')),
named AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical["''\s/>]')
      THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
      ELSE regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''\s>;]+)', 1) END AS link
  FROM tags WHERE regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical["''\s/>]')
     OR regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh["''\s/>]')),
edges AS (
  SELECT {_alias_sql('url')} AS a, {_alias_sql('target')} AS b FROM (
    SELECT url, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link
      WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
      WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link END AS target
    FROM named WHERE link != '')),
both_ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach(a, b) AS (
  SELECT page, page FROM parsed WHERE page IS NOT NULL UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
root AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
judged AS (
  SELECT parsed.*, rule, action, component FROM parsed LEFT JOIN fits USING (page_id, url) LEFT JOIN root ON page = root.a),
flags AS (
  SELECT component, bool_or(action = 'allow') AS ok FROM judged
  WHERE action IS NOT NULL AND component IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN NOT ok THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN flags ON judged.component = flags.component
"""


@query("op8_url_filters", OP8_SQL)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.urlrules import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


@query("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.warc import warc_roundtrip

    return warc_roundtrip(table(spark, sf_dir, "pages"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.outliers import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.spans import dedup_spans

    return dedup_spans(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.gru import languages

    return languages(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.unigram import pieces_of, token_counts

    return token_counts(table(spark, sf_dir, "documents"), pieces_of(tokenizer_file("piece_bpe_32k.model")))


OP11_SQL = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.uid AS asked, q.vec_id AS query_id, c.uid, c.vec_id,
    coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score
  FROM vectors q JOIN vectors c ON q.uid != c.uid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
  vec_id, CAST(score AS BIGINT) AS score
FROM scored QUALIFY rank <= 5
"""


@query("op11_exact_topk", OP11_SQL)
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.pivots import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, h.f AS l, t.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts JOIN grams h ON h.lang = cuts.lang AND h.phrase = head AND h.k = c
  JOIN grams t ON t.lang = cuts.lang AND t.phrase = tail AND t.k = cuts.k - c),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
covers AS (
  SELECT lang, phrase, max(a) AS cover FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN covers ON lowest.lang = covers.lang AND lowest.phrase = covers.phrase AND lowest.k = 2
  WHERE cover IS NULL OR 100 * cover < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN totals ON kept.lang = totals.lang QUALIFY rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setwright.llm.spellings import spellings

    return spellings(table(spark, sf_dir, "documents"))
