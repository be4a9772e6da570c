"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import identify_languages, learn_languages
from .line_dedup import dedup_lines
from .media import encode_media, media_digests
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .packing import pack
from .quality import learn_quality, score_quality
from .shared import id_bucket
from .token_counts import count_tokens
from .url_reputation import Reputation, Rule, host_and_path, judge_urls
from .vector_join import near_vectors


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a CRC-32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", names["topic"], names["n_tokens"], F.round(names["probability"], 6).alias("probability"))


def _raking_sql(rounds: int) -> tuple[str, str]:
    """SQL that scales the weights of ``r0`` to each goal in turn, and the name of the last step."""
    steps, last = [], "r0"
    for k in range(rounds):
        for d in ("source", "lang", "topic"):
            step = f"r{k}_{d}"
            held = f"sum(weight) OVER (PARTITION BY {d})"
            steps.append(f"{step} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {held} > 0 THEN weight * goal_{d} / {held} ELSE 0 END AS weight) FROM {last})")
            last = step
    return ",\n".join(steps), last


def _op1_sql() -> str:
    steps, last = _raking_sql(12)
    goals = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), 0.7) / (SELECT sum(p) FROM (SELECT pow(sum(tokens), 0.7) AS p FROM cells GROUP BY {d})) AS goal_{d}" for d in ("source", "lang", "topic"))
    return f"""
WITH docs AS (
  SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l,
    greatest(len(regexp_extract_all(coalesce(text, ''), '\\S+')), 1)::BIGINT AS n_tokens, CASE
      WHEN 10 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))) > len(regexp_extract_all(coalesce(text, ''), '\\S+')) THEN 'table'
      WHEN lower(coalesce(text, '')) LIKE '%license%' OR lower(coalesce(text, '')) LIKE '%rights reserved%' THEN 'legal'
      WHEN length(coalesce(text, '')) < 600 THEN 'brief' WHEN length(coalesce(text, '')) < 6000 THEN 'article' ELSE 'long' END AS topic,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM documents),
cells AS (SELECT s AS source, l AS lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
r0 AS MATERIALIZED (SELECT *, {goals}, tokens / sum(tokens) OVER () AS weight FROM cells),
{steps},
rates AS (SELECT *, weight / tokens AS rate FROM {last}),
factors AS (
  SELECT *, row_number() OVER falling AS nth,
    (0.7 * sum(tokens) OVER () - coalesce(sum(tokens) OVER (falling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (falling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
  FROM rates WINDOW falling AS (ORDER BY rate DESC, source, lang, topic)),
chosen AS (SELECT arg_min(factor, nth) AS factor FROM factors WHERE factor * rate <= 1),
chances AS (SELECT f.source, f.lang, f.topic, least(1, coalesce(c.factor * rate, 1)) AS p FROM factors f, chosen c)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability
FROM docs d JOIN chances c ON d.s = c.source AND d.l = c.lang AND d.topic = c.topic WHERE draw < p
"""


OP1_SQL = _op1_sql()


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bucket = id_bucket("doc_id", 5)
    model = learn_languages(docs, bucket != 0)
    found, _ = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(bucket == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bucket = id_bucket("doc_id", 4)
    model = learn_quality(docs, read(spark, sf_dir, "labels"), bucket != 2)
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "nearest")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(encode_media(read(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", names["n_lines"], names["n_removed"])


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
full_lines AS (
  SELECT doc_id, pos, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p
  FROM lines WHERE trim(line, ' ') <> ''),
windows AS (
  SELECT doc_id, p, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, p) AS nth FROM windows WHERE l3 IS NOT NULL)
  WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM later),
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.p IS NOT NULL AS is_full, c.p IS NOT NULL AS goes
  FROM lines l LEFT JOIN full_lines f ON l.doc_id = f.doc_id AND l.pos = f.pos LEFT JOIN covered c ON f.doc_id = c.doc_id AND f.p = c.p),
texts AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text,
    count(*) FILTER (is_full)::INT AS n_lines, count(*) FILTER (goes)::INT AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN texts t USING (doc_id)
"""


#: Rules of the url query: host, path, verdict.
URL_RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]
#: One standard deviation below the posterior mean must exceed the share of bad pages among all.
URL_REPUTATION = Reputation(z=1.0)


def document_of(url: Column) -> Column:
    """The id of a page's document: the number that ends the url's path, before ``.html`` or a slash."""
    return F.regexp_extract(host_and_path(url)[1], r"/([0-9]{1,18})(\.html)?/?$", 1).try_cast("long")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls of labelled pages: bad where the page's document has quality 0 (of several labels the least)."""
    quality = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("doc_")).agg((F.min("quality") == 0).alias("bad"))
    return pages.select("url", document_of(F.col("url")).alias("doc_")).join(quality, "doc_").select("url", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge_urls(pages, page_outcomes(pages, read(spark, sf_dir, "labels")), URL_RULES, URL_REPUTATION)


def _level_sql(name: str, source: str, mean: str) -> str:
    """SQL of one level's prior strength, as ``_overlap`` finds it."""
    return f"""{name}_sums AS (
      SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn,
        sum(n * pow(x / n - {mean}, 2)) AS s, sum(n * {mean} * (1 - {mean})) AS v FROM {source} WHERE n > 0),
    {name}_overlap AS (
      SELECT CASE WHEN coalesce(v, 0) = 0 THEN 1 / 11 ELSE least(greatest(
        CASE WHEN n - nn / n - (k - 1) > 0 THEN (s / (v / n) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0 END, 1 / 11), 0.9999) END AS r FROM {name}_sums),
    {name}_strength AS (SELECT (1 - r) / r AS w FROM {name}_overlap)"""


OP9_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM raw),
labelled AS (
  SELECT host, bad FROM (SELECT host, try_cast(regexp_extract(path, '/([0-9]{{1,18}})([.]html)?/?$', 1) AS BIGINT) AS doc_id FROM urls)
  JOIN (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)),
hosts AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad::INT), 0)::DOUBLE AS x, string_split(host, '.') AS parts FROM labelled WHERE host <> '' GROUP BY host),
named AS (
  SELECT host, n, x, parts[-1] AS suffix, CASE WHEN len(parts) > 1 THEN parts[-2] || '.' || parts[-1] ELSE host END AS domain FROM hosts),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0) FROM named) AS base FROM named GROUP BY suffix),
{_level_sql("suffix", "suffixes", "base")},
suffix_means AS (SELECT suffix, (x + w * base) / (n + w) AS suffix_mean FROM suffixes, suffix_strength),
domains AS (
  SELECT d.*, suffix_mean FROM (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM named GROUP BY ALL) d JOIN suffix_means USING (suffix)),
{_level_sql("domain", "domains", "suffix_mean")},
domain_means AS (SELECT domain, (x + w * suffix_mean) / (n + w) AS domain_mean FROM domains, domain_strength),
host_means AS (SELECT host, n, x, domain_mean FROM named JOIN domain_means USING (domain)),
{_level_sql("host", "host_means", "domain_mean")},
shapes AS (SELECT host, x + w * domain_mean AS a, n - x + w * (1 - domain_mean) AS b FROM host_means, host_strength),
blocked AS (
  SELECT host, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > (SELECT sum(x) / sum(n) FROM named) AS blocked FROM shapes),
ruled AS (
  SELECT u.page_id, u.host, u.path, CASE
    WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND starts_with(u.path, '/de/8') THEN 'example.net/de/8'
    WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND starts_with(u.path, '/en/7') THEN 'example.com/en/7'
    WHEN (u.host = 'com' OR u.host LIKE '%.com') AND starts_with(u.path, '/en/') THEN 'com/en/'
    WHEN (u.host = 'net' OR u.host LIKE '%.net') AND starts_with(u.path, '/de/') THEN 'net/de/'
    WHEN (u.host = 'org' OR u.host LIKE '%.org') AND starts_with(u.path, '/es/') THEN 'org/es/' END AS rule,
    coalesce(b.blocked, false) AS blocked
  FROM urls u LEFT JOIN blocked b USING (host))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_media": op7_media,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_url_filters": OP9_SQL,
}
