"""Driver queries of the training-data operators, each over its whole table, and SQL for those that DuckDB can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specdag.llm import oracles
from specdag.llm.common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from specdag.llm.packing import pack

    files = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), **files, longest=2048, keep_ids=False)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.common import remainder
    from specdag.llm.suffix_tree import score

    # a third word gains little (README) and costs a quarter more of disk
    return score(read(spark, sf_dir, "documents"), lambda i: remainder(i, 7) == 2, depth=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.common import remainder
    from specdag.llm.toxicity import fit, score

    docs, held_out = read(spark, sf_dir, "documents"), lambda i: remainder(i, 3) == 1
    model = fit(docs, read(spark, sf_dir, "labels"), held_out)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.sharding import shard

    placed = shard(read(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.pii import KINDS, find_pii, listed, scores

    found = find_pii(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.array_size(F.filter(F.transform("spans", lambda s: s["kind"]), F.lit(k.name).eqNullSafe)).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores(F.col("spans")).alias("scores"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.decontamination import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.quality_rules import apply_policy, ledger, policy_mask

    rows = apply_policy(ledger(read(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.quality_rules import ablation, ledger

    return ablation(ledger(read(spark, sf_dir, "documents")), "v1")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.common import remainder
    from specdag.llm.quality_gam import classify, fit

    docs, held_out = read(spark, sf_dir, "documents"), lambda i: remainder(i, 5) == 0
    model = fit(docs, read(spark, sf_dir, "labels"), held_out)
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.near_dup import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specdag.llm.common import remainder
    from specdag.llm.language import fit, identify

    docs, held_out = read(spark, sf_dir, "documents"), lambda i: remainder(i, 4) == 2
    found = identify(docs, fit(docs, held_out), keep_spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "quality_ablation": quality_ablation,
    "op8_quality_gam": op8_quality_gam,
    "op9_near_dup": op9_near_dup,
    "op10_language": op10_language,
}

#: The others are learned, tokenize, or pack and link in ways that SQL cannot state or not over whole tables; tests hold
#: those against brute force.
ORACLES: dict[str, str] = {"op5_pii": oracles.PII, "op7_quality_rules": oracles.QUALITY_RULES, "quality_ablation": oracles.QUALITY_ABLATION}
