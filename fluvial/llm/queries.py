"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.llm import curriculum, fill_middle, filter_audit, fingerprint, grammar, jaccard_join, licenses, media, packing, sharding, suffix_tree, token_counts, toxicity
from fluvial.llm.common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_time_varying_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.in_order(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), "rank")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(8)
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), tree, sharding.grown(tree))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_features(table(spark, sf_dir, "documents"))


def op11_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.stored_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(table(spark, sf_dir, "documents"), digests=True).drop("segments")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_suffix_tree_scores": op2_suffix_tree_scores,
        "op3_power_of_two_packing": op3_power_of_two_packing,
        "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
        "op5_time_varying_curriculum": op5_time_varying_curriculum,
        "op6_license_scan": op6_license_scan,
        "op7_weighted_hash_tree": op7_weighted_hash_tree,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_token_counts": op9_token_counts,
        "op10_progressive_jpeg": op10_progressive_jpeg,
        "op11_repair_files": op11_repair_files,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_time_varying_curriculum": curriculum.oracle(),
        "op7_weighted_hash_tree": sharding.oracle(),
        "op8_ngram_jaccard_join": jaccard_join.oracle(),
        "op12_fill_in_middle": fill_middle.oracle(),
        "op13_filter_audit": filter_audit.oracle(),
    }
