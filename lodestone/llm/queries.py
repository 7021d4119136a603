"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attribution import attribute_stream
from .chat import chat_digests, format_chats, text_part
from .common import read_table
from .exact import exact_dedup
from .fingerprint import fingerprint_documents
from .language import identify
from .near import near_duplicates
from .packing import pack_documents, read_tokenizer
from .pieces import piece_digests, read_model
from .quality import score_quality
from .shingles import jaccard_components
from .toxicity import tag_toxicity
from .urls import drawn_list, filter_urls
from .whitening import whiten


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("n_chars")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(hard).alias("text"))
    return chat_digests(format_chats(said.unionByName(more).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time and no list: the time is drawn from page_id, the list from hosts and URLs (MD5)."""
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    second = F.col("page_id") * 7919 % (730 * 86400)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.unix_seconds(begin) + second).alias("fetched_at"))
    return filter_urls(pages, drawn_list(pages)).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"), read_model(model_path or vocabulary("piece_bpe_32k.model")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), read_tokenizer(tokenizer_path or vocabulary("byte_bpe_50k.json")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return tagged.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), offsets.alias("offsets"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"), 32)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op13_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_stream(read_table(spark, sf_dir, "clicks"), read_table(spark, sf_dir, "sales"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_url_filters": op6_url_filters,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_attribution": op13_attribution,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), r AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER w = 1 AS kept
            FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op3_chat_formatting": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS escaped FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, escaped)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, escaped) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(9 + length(role) + 1 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
               CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
        FROM e GROUP BY conv_id
    """,
    "op6_url_filters": r"""
        WITH pages_at AS (
            SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % (730 * 86400)) AS t,
                   regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::\d*)?(?:[/?#]|$)', 1) AS host,
                   regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)?', 1), '/+$', '') AS path
            FROM pages
        ), keys AS (
            SELECT 'domain' AS kind, host AS rule FROM pages_at WHERE host <> ''
            UNION SELECT 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM pages_at WHERE host <> ''
            UNION SELECT 'url', host || path FROM pages_at WHERE host <> ''
        ), drawn AS (
            SELECT kind, rule, CASE WHEN CAST('0x' || substr(md5(rule), 1, 1) AS INT) < 10 THEN 'block' ELSE 'allow' END AS action,
                   CAST('0x' || substr(md5(rule), 3, 3) AS INT) % 600 AS a,
                   CAST('0x' || substr(md5(rule), 6, 2) AS INT) AS stays,
                   CAST('0x' || substr(md5(rule), 8, 2) AS INT) + 1 AS gap
            FROM keys WHERE CAST('0x' || substr(md5(rule), 2, 1) AS INT) < 12
        ), spans AS (
            SELECT kind, rule, action, TIMESTAMP '2024-01-01' + to_days(a) AS f, TIMESTAMP '2024-01-01' + to_days(a + stays) AS u FROM drawn WHERE stays > 0
            UNION ALL
            SELECT kind, rule, action, TIMESTAMP '2024-01-01' + to_days(CASE WHEN stays > 0 THEN a + stays + gap ELSE a END), NULL FROM drawn
        ), hits AS (
            SELECT p.page_id, p.url, p.t, p.host, s.kind, s.rule, s.action,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY s.kind = 'url' DESC, length(s.rule) DESC, s.action = 'allow' DESC, s.rule DESC) AS no
            FROM pages_at p LEFT JOIN spans s
              ON p.host <> '' AND p.t >= s.f AND (s.u IS NULL OR p.t < s.u)
             AND ((s.kind = 'url' AND s.rule = p.host || p.path) OR (s.kind = 'domain' AND (p.host = s.rule OR ends_with(p.host, '.' || s.rule))))
        )
        SELECT page_id, url, strftime(t, '%Y-%m-%d %H:%M:%S') AS fetched_at, nullif(host, '') AS host,
               coalesce(action, 'allow') AS verdict, rule, kind AS rule_kind
        FROM hits WHERE no = 1
    """,
    "op13_attribution": r"""
        WITH table_of AS (
            SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
        ), said AS (
            SELECT 'click' AS kind, click_id AS id, client_id, epoch_us(ts) AS us, min(epoch_us(arrived_at)) AS came FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
            UNION ALL
            SELECT 'sale', sale_id, client_id, epoch_us(sold_at), epoch_us(arrived_at) FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
        ), hours AS (
            SELECT kind, id, client_id, us, coalesce(came, us) // 3600000000 + CASE WHEN xor(list_reduce(
                       list_prepend(4294967295, list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 4 = 0 THEN 240 ELSE 0 END AS h
            FROM said, table_of
        ), ends AS (SELECT min(h) AS lo, max(h) AS hi FROM hours WHERE kind = 'click'
        ), dealt AS (
            SELECT kind, id, client_id, us, CAST(greatest(0, least(11, 12 * (h - lo) // (hi - lo + 1))) AS INT) AS batch FROM hours, ends
        ), tops AS (
            SELECT b.batch, (SELECT max(us) FROM dealt d WHERE d.kind = 'click' AND d.batch < b.batch) AS click, (SELECT max(us) FROM dealt d WHERE d.kind = 'sale' AND d.batch < b.batch) AS sale
            FROM (SELECT CAST(range AS INT) AS batch FROM range(12)) b
        ), marks AS (SELECT batch, least(click, sale) - 21600000000 AS w FROM tops WHERE click IS NOT NULL AND sale IS NOT NULL
        ), clicked AS (
            SELECT d.id, d.client_id, d.us FROM dealt d LEFT JOIN marks m USING (batch) WHERE d.kind = 'click' AND (m.w IS NULL OR d.us >= m.w)
        ), sold AS (
            SELECT d.id, d.client_id, d.us, d.batch, coalesce(d.us < m.w, FALSE) AS late,
                   coalesce((SELECT min(x.batch) FROM marks x WHERE x.batch > d.batch AND d.us < x.w), 12) AS closes
            FROM dealt d LEFT JOIN marks m USING (batch) WHERE d.kind = 'sale'
        ), met AS (
            SELECT s.id, max((c.us, -c.id)) AS last, count(*) AS n FROM sold s JOIN clicked c ON c.client_id = s.client_id AND c.us BETWEEN s.us - 604800000000 AND s.us
            WHERE NOT s.late GROUP BY s.id
        )
        SELECT s.id AS sale_id, CAST(CASE WHEN s.late THEN s.batch ELSE s.closes END AS INT) AS batch, s.late, -m.last[2] AS click_id, coalesce(m.n, 0) AS n_clicks FROM sold s LEFT JOIN met m USING (id)
    """,
}
