"""The registered queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.llm import alignment, chat, embedding_dedup, fingerprint, minhash, packing, quality_classifier, quality_rules, sentencepiece, toxicity, url_filter, warc, whitening
from riskweave.llm.common import staged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for low quality, 1 for good but toxic, 2 for good.  Kept: P(grade >= 1) of at least one half."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return quality_classifier.scores(docs, quality_classifier.learn(docs, ratings), at_least=1)


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = sentencepiece.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    read = sentencepiece.encode(table(spark, sf_dir, "documents"), pieces, decoded=True)
    return read.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))


@query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.digests(chat.read_back(chat.formatted(turns)))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
h AS (SELECT p.page_id, g.first, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS hex FROM p JOIN g USING (html))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(k // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) // CAST(pow(2, 35 - 5 * (k % 8)) AS BIGINT)) % 32 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""


@query("op4_warc", WARC_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), min_revisit_bytes=0)


@query("op5_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query("op6_embedding_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own; a page is bad where the label of its number is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def quality_rules_sql() -> str:
    quote = lambda text: text.replace("'", "''")
    words = lambda text: rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, w FROM t),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos], w[pos + 1], w[pos + 2]) AS times FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM g WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
v AS (SELECT *, len(w) AS n FROM (SELECT doc_id, line, {words("line")} AS w FROM l)),
j AS (SELECT doc_id, line, w, n > 0 AND (
    (n < 4 AND NOT regexp_matches(line, '{quote(quality_rules.SENTENCE_END)}'))
    OR (n <= 12 AND regexp_matches(lower(line), '{"|".join(quality_rules.BOILERPLATE)}'))
    OR (n >= 5 AND len(regexp_extract_all(line, '[#*$%&|<>]')) * 4 >= n)
    OR (len(list_filter(w, lambda x: x IN ('|', '›', '»', '•', '·', '>'))) >= 3 AND len(list_filter(w, lambda x: x IN ('|', '›', '»', '•', '·', '>'))) * 4 >= n)
    OR (n >= 5 AND regexp_matches(line, '\p{{Lu}}{{3}}') AND len(regexp_extract_all(line, '\p{{Lu}}')) * 10 >= len(regexp_extract_all(line, '\p{{L}}')) * 7)
    OR (n >= 8 AND len(list_distinct(w)) * 3 <= n)) AS fails FROM v),
s AS (SELECT doc_id, count(*) FILTER (len(w) > 0) - count(DISTINCT line) FILTER (len(w) > 0) AS dup,
  coalesce(sum(length(array_to_string(w, ''))) FILTER (fails), 0) AS lost FROM j GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, lost FROM t JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
d AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN 100e0 * lost / word_chars ELSE 0e0 END AS lost_pct FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_pct, NOT base_failed AND lost_pct <= 50 AS kept FROM d
"""


@query("op9_quality_rules", quality_rules_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = staged(packing.pieces(table(spark, sf_dir, "documents")), "packing")
    packed = packing.pack(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query("op11_document_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), vector="embedding", components=16, weights="one")
