"""The package's queries and their DuckDB SQL."""

from __future__ import annotations

from chronolode.llm import ann, decontaminate, html_text, line_dedup, packing, quality, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op7_packing": packing.op7_packing,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
}
