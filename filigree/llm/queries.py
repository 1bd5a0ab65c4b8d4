"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import ready
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), width=5).select("doc_id", "n_shingles", "component_id")


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, fit

    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_shards import hilbert_shards

    return hilbert_shards(table(spark, sf_dir, "documents"), shards=16)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_importance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), capacity=2048)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .latent_leaks import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


__all__ = ["ORACLES", "QUERIES", "table", "tokenizer_path"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_toxicity": op5_toxicity,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_importance_rules": op7_importance_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op10_latent_leaks": op10_latent_leaks,
}
