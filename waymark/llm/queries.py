"""The driver's queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, clustering, hard_negatives, jaccard, language, line_dedup, media, mixing, oracles, packing, token_files, toxicity, url_filter
from .common import table

CONTROL_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "position").orderBy("position", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "glob")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, end_id=1)
    return token_files.read_documents(manifest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, labels, threshold=0.3)
    return scored.select("doc_id", (toxicity.fold() == 2).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs, keep=["doc_id", "lang"]).select("doc_id", "lang", "language", "posterior", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID over web pages: the markup's language, the host's suffix and the first part of the address's path, and priors of hosts."""
    at = lambda k: F.coalesce(F.regexp_extract("url", url_filter.URL_PARTS, k), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1>|<[^>]+>", " ").alias("text"),
        F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", 1)), F.lit("")).alias("markup"),
        F.lower(at(1)).alias("host"), F.nullif(F.regexp_extract(at(2), r"^/([a-z]{2})/", 1), F.lit("")).alias("path"),
    )
    return language.identify(pages, declared="markup", host="host", path="path", key="page_id", keep=["page_id", "host", "markup", "path"])


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = media.describe(media.store_texts(table(spark, sf_dir, "documents")))
    digest = F.md5(F.to_json("keyframe_ranges").cast("binary")).alias("keyframes_md5")
    return described.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "codec", "duration_s", "keyframes", digest,
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(control)))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.apply(docs, line_dedup.find(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_language_id": op8_language_id,
    "op9_chat": op9_chat,
    "op10_permutation_index": op10_permutation_index,
    "op11_line_dedup": op11_line_dedup,
    "op12_sort_means": op12_sort_means,
    "op13_hard_negatives": op13_hard_negatives,
    "language_of_pages": language_of_pages,
}

ORACLE = {
    "op4_jaccard_join": oracles.JACCARD,
    "op7_media": oracles.MEDIA,
    "op9_chat": oracles.CHAT,
    "op11_line_dedup": oracles.LINES,
    "op12_sort_means": oracles.means(),
    "op13_hard_negatives": oracles.NEGATIVES,
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
r AS (
  SELECT *, CAST(sum(cap) OVER o AS BIGINT) - cap AS caps_before,
         CAST(sum(weight) OVER () AS BIGINT) - CAST(sum(weight) OVER o AS BIGINT) + weight AS weights_left,
         CAST(sum(source_size) OVER () AS BIGINT) AS all_words
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (
  SELECT source, source_size, weight,
         least(CAST(cap AS DOUBLE), max(CAST(all_words - caps_before AS DOUBLE) / CAST(weights_left AS DOUBLE)) OVER () * CAST(weight AS DOUBLE)) AS target
  FROM r),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.weight, CAST(floor(t.target) AS BIGINT) AS whole,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, greatest(0, least(size, whole - start)) AS e0, greatest(0, least(size, whole - start - source_size)) AS e1,
         greatest(0, least(size, whole - start - 2 * source_size)) AS e2,
         CASE weight WHEN 1 THEN -0.5::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS tilt
  FROM p)
SELECT doc_id, source, size, source_size, target, CAST(e0 + e1 + e2 AS BIGINT) AS taken,
       CAST(e0 > 0 AS INT) + CAST(e1 > 0 AS INT) + CAST(e2 > 0 AS INT) AS epochs,
       CASE WHEN e0 + e1 + e2 > 0 THEN 2.0::DOUBLE * (CAST(start AS DOUBLE) / target)
         / ((1.0::DOUBLE - tilt) + sqrt((1.0::DOUBLE - tilt) * (1.0::DOUBLE - tilt) + 4.0::DOUBLE * tilt * (CAST(start AS DOUBLE) / target))) END AS position
FROM e""",
    "op3_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
f AS (
  SELECT *, '.' || host AS h,
    CASE WHEN '.' || host LIKE '%.casino%' OR host LIKE '%casino%' THEN '*casino**'
         WHEN host LIKE '%cheap-pills%' THEN '*cheap-pills**'
         WHEN host LIKE '%free-bets%' THEN '*free-bets**'
         WHEN host LIKE '%spam-farm%' THEN '*spam-farm**'
         WHEN '.' || host LIKE '%.ads-track.%' THEN '*.ads-track.**'
         WHEN host || path LIKE '%/wp-login.php' THEN '**/wp-login.php'
         WHEN '.' || host || path LIKE '%.exe' THEN '**.exe' END AS "glob"
  FROM u),
j AS (
  SELECT *, CASE
    WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM f)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block'
         WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block' ELSE CASE WHEN "glob" IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
       "glob"
FROM j""",
}
