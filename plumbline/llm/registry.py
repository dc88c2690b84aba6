"""The queries of this folder and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import langid, mixing, packing, pii, quality, secrets, simhash, substring, topk, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc_salvage": warc.op1_warc_salvage,
    "op2_pii": pii.op2_pii,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_dual_tree_topk": topk.op6_dual_tree_topk,
    "op7_language_id": langid.op7_language_id,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "pipeline": pipeline,
}
ORACLES = {
    "op1_warc_salvage": warc.OP1_SQL,
    "op6_dual_tree_topk": topk.OP6_SQL,
    "op8_substring_dedup": substring.OP8_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
