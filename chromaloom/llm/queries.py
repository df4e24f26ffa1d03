"""The dealt operators as queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import html
import html.entities
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, host_rules, mixing, packing, periodic, quality, simhash, substring, tokens, topk, url_filter, warc

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix whose weights are stated, whatever a source has: 1 to 5 by the number in its name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    mixed = mixing.mix_sources(docs, docs.select("source").distinct().withColumn("weight", 1 + number % 5))
    return mixed.select("doc_id", "source", F.col("block").cast("long").alias("block"), F.col("slot").cast("long").alias("slot"), F.col("slot_pos").cast("long").alias("slot_pos"), "in_mix")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page, by their identifiers and digests."""
    d = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return d.select(
        F.col("key").alias("page_id"), "target_uri", "refers_to", "payload_digest", F.md5("source_headers").alias("headers_md5"), "metadata_id", "metadata_digest",
        "conversion_id", "conversion_digest", F.length("conversion_block").alias("n_chars"), "title", "n_links",
    )


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    return host_rules.host_rules(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_url_filter, op2_topk_search, op3_token_counts, op4_mix_sources, op5_quality_classifier, op6_exact_dedup, op7_simhash_groups, op8_substring_dedup, op9_best_fit_packing, op10_warc_derivatives, op11_host_rules, op12_periodic_runs, op13_collocations, pipeline)
    return {f.__name__: f for f in named}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (SELECT page_id, host, path, rhost || rpath AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE n = 1"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
QUALIFY rank <= 20"""

OP4_SQL = f"""WITH RECURSIVE {mixing.mix_sql(weight="1 + coalesce(try_cast(regexp_extract(src, '([0-9]+)$', 1) AS INT), 0) % 5")}
SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot, slot_pos::BIGINT AS slot_pos, slot <= (SELECT h FROM horizon) AS in_mix FROM mixed"""

OP6_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256({LOWERED}) AS h FROM documents) WINDOW g AS (PARTITION BY h)"""


OP8_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM w WHERE len(words) >= 35),
hashed AS (SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS h FROM starts),
often AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM hashed WHERE h IN (SELECT h FROM often)),
lists AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n, coalesce(len(l), 0) AS r, [words[i] FOR i IN range(1, len(words) + 1) IF l IS NULL OR NOT list_contains(l, i)] AS k FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_regex(pattern: str) -> str:
    """A pattern as an SQL string; the possessive *+ gives what * gives and is not known to SQL."""
    return _quoted(pattern.replace("*+", "*"))


def _decoded_ctes(source: str, key: str) -> str:
    """CTEs whose last, ``decoded`` (key, which, t), has the texts of ``source`` (key, which, attribute, t) with HTML5's
    character references decoded, by the rule of attributes or of text: texts are cut into references and the rest, which
    are put together again."""
    named = ", ".join(f"({_quoted(n)}, {_quoted(c)})" for n, c in html.entities.html5.items())
    low = ", ".join(f"({n}, {'chr(13)' if n == 13 else _quoted(html.unescape(f'&#{n};'))})" for n in range(160) if n not in (9, 10, 12, 32))
    gone = "n BETWEEN 64976 AND 65007 OR n % 65536 IN (65534, 65535)"  # noncharacters
    cuts = [f"regexp_extract_all(t, {_sql_regex(f'{p.pattern}|[^&]+|&')})" for p in (warc.ATTRIBUTE_REFERENCE, warc.REFERENCE)]
    return f"""
refs(name, c) AS (VALUES {named}),
low(n, c) AS (VALUES {low}),
cut AS (SELECT {key}, which, attribute, CASE WHEN attribute THEN {cuts[0]} ELSE {cuts[1]} END AS l FROM {source}),
pieces AS (SELECT {key}, which, attribute, unnest(l) AS piece, unnest(range(len(l))) AS i FROM cut),
marks AS (SELECT DISTINCT piece, attribute FROM pieces WHERE length(piece) > 1 AND piece[1] = '&'),
numbers AS (SELECT piece, attribute, CASE WHEN length(d) > 12 THEN 9999999 ELSE d::BIGINT END AS n FROM (SELECT piece, attribute, CASE WHEN piece[3] IN ('x', 'X') THEN '0x' || right('0' || ltrim(regexp_extract(piece, '[0-9a-fA-F]+', 0), '0'), 12)
    ELSE '0' || ltrim(regexp_extract(piece, '[0-9]+', 0), '0') END AS d FROM marks WHERE piece[2] = '#')),
known AS (
  SELECT piece, attribute, CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN {gone} THEN '' ELSE coalesce(c, chr(n::INTEGER)) END AS t FROM numbers LEFT JOIN low USING (n)
  UNION ALL
  SELECT piece, false, max_by(c || substr(piece, length(name) + 2), length(name)) AS t FROM marks JOIN refs ON starts_with(substr(piece, 2), name) WHERE piece[2] <> '#' AND NOT attribute GROUP BY piece
  UNION ALL
  SELECT piece, true, c FROM marks JOIN refs ON substr(piece, 2) = name WHERE attribute),
decoded AS (SELECT {key}, which, string_agg(coalesce(replace(t, chr(160), ' '), piece), '' ORDER BY i) AS t FROM pieces LEFT JOIN known USING (piece, attribute) GROUP BY {key}, which)"""


def op10_sql() -> str:
    def uuid(kind: str, key: str) -> str:
        h = f"md5('{kind}:' || {key})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    body = f"regexp_replace(regexp_replace(regexp_replace(html, {_sql_regex(warc.HEAD)}, ' ', 'g'), {_sql_regex(warc.BREAKS)}, chr(10), 'g'), {_sql_regex(warc.TAGS)}, '', 'g')"
    first = f"list_filter(regexp_extract_all(t, {_sql_regex(warc.ATTRIBUTE)}), lambda a: regexp_matches(a, {_sql_regex(warc.HREF)}))[1]"
    tags = f"list_filter(regexp_extract_all(html, {_sql_regex(warc.LINK_TAG)}, 1), lambda t: t <> '')"
    eol = "chr(13) || chr(10)"
    lengths = "'Content-Length: ' || octet_length(encode(html))"
    heads = "".join(f" || {eol} || 'source-header: ' || {_quoted(h)}" for h in warc.HEADERS) + f" || {eol} || 'source-header: ' || {lengths}"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
seen AS (SELECT page_id, regexp_replace(html, {_sql_regex(warc.HIDDEN)}, ' ', 'g') AS html FROM p),
hrefs AS (SELECT page_id, list_transform(list_filter(list_transform({tags}, lambda t: {first}), lambda a: a IS NOT NULL), lambda a: regexp_replace(a, {_sql_regex(warc.HREF)}, '')) AS l FROM seen),
written AS (SELECT page_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM hrefs),
raw AS (SELECT page_id, -2 AS which, false AS attribute, {body} AS t FROM seen UNION ALL SELECT page_id, -1, false, regexp_extract(html, {_sql_regex(warc.TITLE)}, 1) FROM seen
  UNION ALL SELECT page_id, i, true, CASE WHEN v[1] IN (chr(34), chr(39)) THEN substr(v, 2, length(v) - 2) ELSE v END FROM written),
{_decoded_ctes("raw", "page_id")},
lists AS (SELECT page_id, list(v ORDER BY which) AS links FROM (SELECT page_id, which, regexp_replace(regexp_replace(t, '[\t\n\r]', '', 'g'), '^ +| +$', '', 'g') AS v FROM decoded WHERE which >= 0) WHERE v <> '' GROUP BY page_id),
texts AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS txt FROM decoded WHERE which = -2),
titles AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\r\n\f]+', ' ', 'g'), '^ +| +$', '', 'g') AS title FROM decoded WHERE which = -1),
r AS (SELECT page_id, url AS target_uri, html, {uuid("response", "coalesce(page_id::VARCHAR, 'null') || '|' || url || '|' || sha256(html)")} AS rid,
  'sha256:' || sha256(html) AS payload_digest, concat_ws({eol}, {", ".join(map(_quoted, (warc.STATUS, *warc.HEADERS)))}, {lengths}) AS head,
  coalesce(txt, '') AS txt, coalesce(title, '') AS title, coalesce(links, []) AS links FROM p LEFT JOIN texts USING (page_id) LEFT JOIN titles USING (page_id) LEFT JOIN lists USING (page_id)),
m AS (SELECT *, 'refers-to: ' || rid || {eol} || 'source-status: {warc.STATUS}'{heads} || {eol}
  || 'source-payload-digest: ' || payload_digest || {eol} || 'title: ' || title || {eol} || 'outlinks: ' || len(links) || {eol}
  || coalesce(list_reduce(list_transform(links, lambda x: 'outlink: ' || x || {eol}), lambda x, y: x || y, ''), '') AS block FROM r)
SELECT page_id, target_uri, rid AS refers_to, payload_digest, md5(head) AS headers_md5, {uuid("metadata", "rid")} AS metadata_id, 'sha256:' || sha256(block) AS metadata_digest,
  {uuid("conversion", "rid")} AS conversion_id, 'sha256:' || sha256(txt) AS conversion_digest, length(txt)::INTEGER AS n_chars, title, len(links)::INTEGER AS n_links FROM m"""


def oracle_sql() -> dict[str, str]:
    """Token counts, learned scores, SimHash groups and packings are not SQL: their tests use brute force."""
    import corpus_pipeline

    sql = {"op1_url_filter": OP1_SQL, "op2_topk_search": OP2_SQL, "op4_mix_sources": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op10_warc_derivatives": op10_sql(), "op11_host_rules": host_rules.host_rules_sql(), "op12_periodic_runs": periodic.run_digests_sql(), "op13_collocations": collocations.collocations_sql()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
