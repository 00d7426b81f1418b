"""Queries of the language-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planestack.llm import ann, bpe, byte_bpe, collocations, fingerprint, manifest, mixing, near_dedup, quality, repeats, secrets, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_repeats": repeats.op2_repeats,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op4_shares": mixing.op4_shares,
        "op5_secrets": secrets.op5_secrets,
        "op6_nearest": ann.op6_nearest,
        "op7_bpe": bpe.op7_bpe,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_fingerprint": fingerprint.op9_fingerprint,
        "op10_quality": quality.op10_quality,
        "op11_collocations": collocations.op11_collocations,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.OP4_SQL, "op4_shares": mixing.OP4_SHARES_SQL, "op8_url_filter": url_filter.OP8_SQL, "op11_collocations": collocations.OP11_SQL, "op13_manifest": manifest.OP13_SQL}
