"""Queries and oracle SQL of the operators in this package."""

from __future__ import annotations

from braidlake.llm import audio, bpe, dedup, licenses, mixing, pii, quality, sharding, topk, toxicity


def queries():
    return {"op1_toxicity": toxicity.op1_toxicity, "op2_quality": quality.op2_quality, "op3_bpe": bpe.op3_bpe, "op4_media": audio.op4_media, "op5_topk": topk.op5_topk, "op6_pii": pii.op6_pii, "op7_neardup": dedup.op7_neardup, "op8_sharding": sharding.op8_sharding, "op9_licenses": licenses.op9_licenses, "op10_mixing": mixing.op10_mixing}


def oracle_sql():
    return {"op5_topk": topk.OP5_SQL, "op8_sharding": sharding.OP8_SQL, "op10_mixing": mixing.OP10_SQL}
