"""Queries of the pipeline operators, with SQL where it can say the same."""

from __future__ import annotations

from penprint.llm import (
    bpe,
    conversations,
    decontaminate,
    html_text,
    importance,
    jaccard_join,
    line_dedup,
    near_dedup,
    quality_rules,
    secrets,
    sharding,
    token_files,
    warc,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secrets": secrets.op2_secrets,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_html_text": html_text.op7_html_text,
    "op8_warc": warc.op8_warc,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_importance": importance.op11_importance,
    "op12_jaccard": jaccard_join.op12_jaccard,
    "op13_conversations": conversations.op13_conversations,
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op8_warc": warc.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_importance": importance.SQL,
}
