"""The queries of this subpackage, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from lattica.llm import chat, decontaminate, licenses, lm, middle, packing, pii, quality, resample, sharding, simhash, target, toxicity
from lattica.llm.common import table


def op1_virtual_slot_shards(spark, sf_dir):
    return sharding.digest(spark, table(spark, sf_dir, "documents"))


def op2_pii_candidate_boosting(spark, sf_dir):
    return pii.digest(spark, table(spark, sf_dir, "documents"))


def op3_importance_resampling(spark, sf_dir):
    return resample.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_log_frequency_bloom(spark, sf_dir):
    return lm.digest(spark, table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.digest(spark, table(spark, sf_dir, "documents"))


def op6_bm25_decontamination(spark, sf_dir):
    return decontaminate.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_deletion_variants(spark, sf_dir):
    return simhash.digest(spark, table(spark, sf_dir, "documents"))


def op8_license_rules(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"))


def op10_ftrl_toxicity(spark, sf_dir):
    return toxicity.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_formatting(spark, sf_dir):
    return chat.digest(spark, table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark, sf_dir):
    return middle.digest(spark, table(spark, sf_dir, "documents"))


def op13_target_resampling(spark, sf_dir):
    return target.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_virtual_slot_shards,
        op2_pii_candidate_boosting,
        op3_importance_resampling,
        op4_log_frequency_bloom,
        op5_best_fit_packing,
        op6_bm25_decontamination,
        op7_simhash_deletion_variants,
        op8_license_rules,
        op9_quality_rules,
        op10_ftrl_toxicity,
        op11_chat_formatting,
        op12_fill_in_middle,
        op13_target_resampling,
    )
}
ORACLES = {
    "op9_quality_rules": quality.ORACLE,
    "op11_chat_formatting": chat.ORACLE,
    "op12_fill_in_middle": middle.ORACLE,
    "op13_target_resampling": target.ORACLE,
}
