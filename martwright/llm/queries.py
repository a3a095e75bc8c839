"""Registered queries of the corpus operators, over whole tables, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import (
    fill_middle,
    fingerprints,
    language_id,
    packing,
    piece_codec,
    pivot_index,
    quality,
    simhash,
    suffix_dedup,
    token_alignment,
    token_counts,
    token_files,
    url_filter,
)
from martwright.llm.common import read_documents, stored

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def learned_languages(docs: DataFrame) -> language_id.ContextModel:
    taught = docs.where(F.col("doc_id").isNotNull() & ~language_id.is_held_out(F.col("doc_id")))
    return language_id.fit_languages(taught)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = language_id.predict_languages(docs, learned_languages(docs))
    held_out = language_id.is_held_out(F.col("doc_id"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(read_documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_verdicts(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("score", 6).alias("score"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    files = token_files.write_token_files(docs, tokenizer="byte_bpe_50k.json", end_id=2)
    found = stored(token_files.read_checks(files, token_files.document_keys(docs)))
    files.delete(spark)
    return found


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_codec.encode_pieces(read_documents(spark, sf_dir))
    decoded = piece_codec.decode_pieces(encoded)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir), "piece_bpe_32k.model")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read_documents(spark, sf_dir))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pivot_index.nearest_vectors(vectors, F.col("vec_id") % 20 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align_tokenizers(read_documents(spark, sf_dir))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_url_filter": op2_url_filter,
        "op3_language_id": op3_language_id,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_quality": op7_quality,
        "op8_token_files": op8_token_files,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_token_counts": op10_token_counts,
        "op11_fill_middle": op11_fill_middle,
        "op12_nearest_vectors": op12_nearest_vectors,
        "op13_token_alignment": op13_token_alignment,
    }


_URL_SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
    FROM pages
), judged AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), numbered AS (SELECT *, row_number() OVER () AS n FROM judged),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
fitting AS (
    SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
    FROM numbered JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM numbered LEFT JOIN fitting USING (n)
"""


_FILL_MIDDLE_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(
            coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'
        ) AS units,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, units, len(units) AS n,
        CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS cut1,
        CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS cut2,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parted AS (
    SELECT *, array_to_string(units[:least(cut1, cut2)], '') AS prefix,
        array_to_string(units[least(cut1, cut2) + 1:greatest(cut1, cut2)], '') AS middle,
        array_to_string(units[greatest(cut1, cut2) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parted
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_fill_middle": _FILL_MIDDLE_SQL,
        "op2_url_filter": _URL_SQL.format(
            upper=url_filter.UPPER,
            lower=url_filter.LOWER,
            rules=", ".join(str(rule) for rule in URL_RULES),
        ),
    }
