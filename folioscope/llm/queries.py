"""Thin queries over the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, media_avi, near_dup, pieces, quality, sharding, store, token_store, url_filter

#: Rules of the URL filter: fixed values.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, read back from the compacted store. The files of a table of many are its arrivals."""
    documents, root = table(spark, sf_dir, "documents"), store.scratch(spark, "shards")
    files = documents.inputFiles()
    kept = (sharding.ingest_files(spark, files, documents.schema, root) if len(files) >= 8 else sharding.ingest(documents, root)).read()
    return kept.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def part_of(key: str, parts: int) -> Column:
    """The rest of crc32(key as text) by parts."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels, usable=part_of("doc_id", 3) != 1)
    scored = quality.score_documents(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(part_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, numbers of pieces and crc32 of the ids of the best segmentations, and whether decoding each of them gives the text."""
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, usable=part_of("doc_id", 5) != 0)
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(part_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_digests(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules, "page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_decontamination, op3_minhash_near_dedup, op4_html_extraction, op5_quality_classifier, op6_token_ids, op7_sentencepiece_nbest, op8_language_id, op9_media_avi, op10_url_filter)
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_sharding": """
        SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
        FROM documents""",
    "op2_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        spots AS (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS t FROM spots),
        sizes AS (SELECT DISTINCT n FROM win),
        dp AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
        dw AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t FROM dp),
        m AS (SELECT dw.r, dw.s, dw.n, win.item FROM dw JOIN win USING (n, t)),
        hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op3_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE CAST([] AS VARCHAR[]) END)) AS s FROM d),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM both_in JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = d.doc_id""",
    "op10_url_filter": """
        WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
        p AS (SELECT r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
        fit AS (SELECT r, rules.host || rules.path AS rule, verdict FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)),
        best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)""",
}
