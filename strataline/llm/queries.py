"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import table
from strataline.llm.exact_dedup import exact_dedup
from strataline.llm.fingerprints import edited_fingerprints
from strataline.llm.jaccard_join import jaccard_classes
from strataline.llm.language_id import identify_languages, learn_language_model
from strataline.llm.license_scan import scan_licenses
from strataline.llm.packing import pack_documents
from strataline.llm.quality import learn_quality, score_quality
from strataline.llm.sentencepiece_codec import round_trip
from strataline.llm.toxicity import learn_toxicity, tag_toxicity
from strataline.llm.url_filter import filter_urls


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def _held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the documents that models never learn from; null for those without an id, which they don't learn from either."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _said(id_col: str = "doc_id") -> Column:
    """held_out as a result: a row without an id has no remainder, so it isn't held out."""
    return F.coalesce(_held_out(id_col), F.lit(False)).alias("held_out")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_language_model(docs.where(~_held_out()))
    return identify_languages(docs.select("doc_id", _said(), "text"), model).drop("text", "coverage")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again: ids by count and checksum, text by hash."""
    return round_trip(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = learn_quality(docs, table(spark, sf_dir, "labels").where(~_held_out()))
    return score_quality(docs.select("doc_id", _said(), "text"), network).drop("text")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").where(~_held_out()))
    return tag_toxicity(docs.select("doc_id", _said(), "text"), model).drop("text")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents as files ``source/d<id div 100>/...``; short ones with a licence line are licence files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    name = F.when((F.length("text") < 400) & F.lower("text").contains("licens"), F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/d"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), name)
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text")).drop("text")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_language_id, op3_sentencepiece, op4_quality_classifier, op5_url_filter, op6_toxicity, op7_ngram_jaccard_join, op8_license_scan, op9_exact_dedup, op10_best_fit_packing)}

_HOST = "translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
#: The four rules, longest first.
_FIT = "CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN {0} WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN {1} WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN {2} WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN {3} END"

ORACLES = {
    "op5_url_filter": rf"""
        WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*')) AS tag FROM pages),
        hrefs AS (
            SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                   WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
                   WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bproperty\s*=\s*["'']?og:url\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?([^"''\s>]+)', 1) END AS href FROM tags),
        bases AS (SELECT url, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, {_REST.format(url="url")} AS rest FROM hrefs WHERE href <> ''),
        links AS (
            SELECT url AS source, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href
                   WHEN starts_with(href, '/') THEN scheme || '://' || {_HOST.format(rest="rest")} || href
                   ELSE scheme || '://' || {_HOST.format(rest="rest")} || coalesce(nullif(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || href END AS target FROM bases),
        urls AS (SELECT url FROM pages UNION SELECT source FROM links UNION SELECT target FROM links),
        split AS (SELECT url, {_HOST.format(rest=_REST.format(url="url"))} AS host, regexp_extract({_REST.format(url="url")}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS q FROM urls WHERE url IS NOT NULL),
        judged AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN host || coalesce(nullif(path, ''), '/') || q END AS node, {_FIT.format("'example.com/de/'", "'example.net/en/'", "'org/fr/'", "'net/'")} AS rule, {_FIT.format("'block'", "'allow'", "'allow'", "'block'")} AS own FROM split),
        edges AS (SELECT DISTINCT a.node AS x, b.node AS y FROM links JOIN judged a ON a.url = source JOIN judged b ON b.url = target WHERE a.node <> b.node),
        ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
        reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
        verdicts AS (SELECT n.node, bool_or(m.own = 'block') AND NOT coalesce(bool_or(m.own = 'allow'), false) AS blocked
                     FROM (SELECT DISTINCT node FROM judged WHERE node IN (SELECT source_node FROM (SELECT a.node AS source_node FROM links JOIN judged a ON a.url = source UNION SELECT b.node FROM links JOIN judged b ON b.url = target))) n
                     JOIN (SELECT x, y FROM reach UNION SELECT node, node FROM judged WHERE node IS NOT NULL) r ON r.x = n.node JOIN judged m ON m.node = r.y GROUP BY n.node)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
        FROM pages LEFT JOIN judged USING (url) LEFT JOIN verdicts USING (node)
    """,
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words),
        grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, len(s.s) AS n_shingles,
               least(s.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = s.doc_id), s.doc_id)) AS component_id,
               (SELECT count(*) FROM links l WHERE l.x = s.doc_id) AS n_links
        FROM sets s
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
