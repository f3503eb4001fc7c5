"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import chat, decontaminate, exact_dedup, html_text, jaccard_join, mixing, quality, suffix_dedup, token_table, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_quality": quality.op2_quality,
    "op3_warc": warc.op3_warc,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_token_table": token_table.op8_token_table,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_text": html_text.op10_html_text,
}
ORACLES = {
    "op1_chat": chat.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
