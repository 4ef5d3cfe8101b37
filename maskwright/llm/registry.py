"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from maskwright.llm import decontaminate, exact, mixing, near, pii, secret_scan, sharding, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_warc": warc.op3_warc,
        "op4_shard": sharding.op4_shard,
        "op5_near_dedup": near.op5_near_dedup,
        "op6_pii": pii.op6_pii,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_exact_dedup": exact.op8_exact_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op3_warc": warc.OP3_SQL, "op8_exact_dedup": exact.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL}
