"""Registered queries of this subpackage with their reference SQL."""

from tracklens.llm import decontamination, exact_dedup, fill_middle, manifest, mixing, pii, quality, secrets, sharding, simhash, token_counts, toxicity, url_filters

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_secrets": secrets.op3_secrets,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_sharding": sharding.op11_sharding,
    "op12_manifest": manifest.op12_manifest,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLE = {
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_sharding": sharding.OP11_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
