"""One query for each operator of this subpackage, over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import centroids, decontamination, fill_middle, mixing, near_dup, quality, quality_classifier, repeats, secrets, sharding, sql, token_ids, toxicity, url_rules
from lodestone.tables import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.with_totals(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.clusters(table(spark, sf_dir, "documents"), near_dup.Params(shingle=2))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.judged(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.trained(docs, table(spark, sf_dir, "labels")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_quality_rules": op3_quality_rules,
        "op4_near_dup": op4_near_dup,
        "op5_mixing": op5_mixing,
        "op6_secrets": op6_secrets,
        "op7_repeats": op7_repeats,
        "op8_url_rules": op8_url_rules,
        "op9_decontamination": op9_decontamination,
        "op10_token_ids": op10_token_ids,
        "op11_quality_classifier": op11_quality_classifier,
        "op12_fill_middle": op12_fill_middle,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sql.sharding(),
        "op3_quality_rules": sql.quality_rules(),
        "op8_url_rules": sql.url_rules(),
        "op12_fill_middle": sql.fill_middle_digests(),
        "op13_centroids": sql.clusters(),
    }
