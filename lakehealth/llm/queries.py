"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and derives the columns its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehealth.llm import (bpe, decontam, hardneg, htmltext, jaccard, langid, linededup, merkle, quality, sharding, tokenfile,
                            topk, weakrules)
from lakehealth.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "source", "quality_score", "quality_keep")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = linededup.mark(table(spark, sf_dir, "documents"))
    return marked.select("row.doc_id", "text", "n_lines", "n_equal", "n_near")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


#: Id that ends every document in the token files.
END_ID = 2


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.fresh_path(spark)
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path,
                                public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokenfile.read_documents(spark, path)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"),
                                 public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weakrules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.fresh_path(spark))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.prepared(hardneg.shifted_labels(table(spark, sf_dir, "embeddings")))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_main_text": op5_main_text,
    "op6_token_file": op6_token_file,
    "op7_exact_topk": op7_exact_topk,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op7_exact_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_quality_rules": weakrules.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
    "op13_hard_negatives": hardneg.ORACLE_SQL,
}
