"""The operators of this package as named queries over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.llm import binary, decontaminate, fixity, language, lines, manifest, mixing, neardup, pii, quality, spelling, suffixes, tokens
from runledger.llm.common import documents


def vocabulary(name: str) -> str:
    """Where an installed public vocabulary lies; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    found = fixity.audit_of_pages(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select("page_id", "length", "kind", "sha256_one", "sha256_two")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    ids = F.col("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(documents(spark, folder))
    counts = [F.size(F.array_remove("base.kind", kind)) for kind in pii.KINDS]
    counts = [(F.size("base") - others).cast("long").alias(f"n_{kind}") for kind, others in zip(pii.KINDS, counts)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op5_near_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.repeated_lines(documents(spark, folder))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, folder), size=4)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op7_count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, folder), vocabulary("piece_bpe_32k.model"))


def op8_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(documents(spark, folder))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return binary.tokens_on_file(documents(spark, folder), vocabulary("word_bpe_49k.json"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, folder)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = manifest.audited_documents(documents(spark, folder))
    proof = F.sha2(manifest.path_text(F.col("path")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Query]:
    known = (op1_mix_sources, op2_fixity_audit, op3_decontaminate, op4_personal_data, op5_near_lines, op6_near_duplicates, op7_count_tokens, op8_quality_votes, op9_token_files, op10_language, op11_spelling_variants, op12_dataset_manifest, op13_suffix_dedup)
    return {query.__name__: query for query in known}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE_SQL, "op2_fixity_audit": fixity.ORACLE_SQL, "op12_dataset_manifest": manifest.ORACLE_SQL}
