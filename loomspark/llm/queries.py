"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from loomspark.llm import decontamination, langid, neardup, pii, quality, repeats, sharding, url_filter
from loomspark.llm.packing import op6_best_fit_packing
from loomspark.llm.token_files import op10_token_files

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_language_id,
        pii.op2_pii_sanitisation,
        neardup.op3_minhash_neardup,
        quality.op4_quality_rules,
        sharding.op5_consistent_hash_shards,
        op6_best_fit_packing,
        decontamination.op7_decontamination,
        repeats.op8_repeated_bytes,
        url_filter.op9_url_reputation,
        op10_token_files,
    )
}
ORACLE = {"op4_quality_rules": quality.SQL, "op7_decontamination": decontamination.SQL, "op9_url_reputation": url_filter.SQL}
