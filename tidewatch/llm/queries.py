"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import encode_decode
from tidewatch.llm.crosstoken import align_tokenizers
from tidewatch.llm.exact import exact_groups
from tidewatch.llm.language import Languages, identify
from tidewatch.llm.license import scan_licenses
from tidewatch.llm.metric import vector_groups
from tidewatch.llm.ngram import BigramModel, score_documents
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.phrases import contamination
from tidewatch.llm.simhash import simhash_groups
from tidewatch.llm.spelling import spelling_variants
from tidewatch.llm.toxicity import Toxicity, score_texts
from tidewatch.llm.warc import archive_pages


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(parts: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as 1, so it is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(parts)), F.lit(1))


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", (remainder(5) == 0).alias("held_out"))
    model = Languages.fit(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_shares")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    model = Toxicity.fit(docs.filter(~F.col("held_out")), table(spark, sf, "labels"))
    return score_texts(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return encode_decode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archive_pages(table(spark, sf, "pages"))


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(table(spark, sf, "documents"))


def op7_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vector_groups(table(spark, sf, "embeddings"))


def op8_exact(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(table(spark, sf, "documents"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", (remainder(10) == 0).alias("held_out"))
    model = BigramModel.fit(docs.filter(~F.col("held_out")))
    return score_documents(docs, model).drop("text")


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


def op12_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align_tokenizers(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_license": op4_license,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_vectors": op7_vectors,
    "op8_exact": op8_exact,
    "op9_packing": op9_packing,
    "op10_ngram": op10_ngram,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op5_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), marked AS (
            SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
        ), firsts AS (
            SELECT payload_digest, min(page_id) AS first_id FROM marked WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM marked LEFT JOIN firsts USING (payload_digest)
    """,
    "op7_vectors": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
        ), reached AS (
            SELECT vec_id, vec_id AS other FROM embeddings
            UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
        ), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(max(n), 0) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
        FROM reached LEFT JOIN counted USING (vec_id) GROUP BY vec_id
    """,
    "op8_exact": """
        WITH normal AS (
            SELECT doc_id,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ), marked AS (
            SELECT doc_id, sha256(body) AS text_sha256 FROM normal
        ), counted AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM marked GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM marked JOIN counted USING (text_sha256)
    """,
    "op12_decontamination": """
        WITH docs AS (
            SELECT row_number() OVER () AS k, doc_id,
                   list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
            FROM documents
        ), items AS (
            SELECT item_id,
                   list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
            FROM benchmark
        ), sized AS (
            SELECT *, least(10, len(words)) AS m FROM items WHERE len(words) > 0
        ), windows AS (
            SELECT DISTINCT item_id, m, array_to_string(words[s:s + m - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS s FROM sized)
        ), grams AS (
            SELECT k, m, s, array_to_string(words[s:s + m - 1], ' ') AS gram
            FROM (SELECT k, words, m, unnest(range(1, len(words) - m + 2)) AS s FROM docs, (SELECT DISTINCT m FROM sized) WHERE len(words) >= m)
        ), found AS (
            SELECT k, s, m, item_id FROM grams JOIN windows USING (m, gram)
        ), hits AS (
            SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT k, s, m FROM found)) GROUP BY k
        ), listed AS (
            SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM found GROUP BY k
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (k) LEFT JOIN listed USING (k)
    """,
}
