"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe, decontaminate, language_id, line_dedup, lm_scoring, minhash_dedup, ngram_join, packing, prefix_trie, quality_rules, spelling, substring_dedup, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.remove_lines(docs)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    found = language_id.identify(docs, ~F.col("held_out") & F.col("doc_id").isNotNull())  # a null id has no remainder
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return packing.pack(docs, ranks, public_tokenizers.PATTERN)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    targets = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score(docs, targets)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = quality_rules.judge(docs)
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_url_filters": op2_url_filters,
        "op3_line_dedup": op3_line_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_language_id": op5_language_id,
        "op6_packing": op6_packing,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality_rules": op10_quality_rules,
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_spelling": op12_spelling,
        "op13_prefix_trie": op13_prefix_trie,
    }
