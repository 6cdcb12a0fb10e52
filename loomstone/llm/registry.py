"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from loomstone.llm import chat, decontaminate, html_text, infill, nearest, ngram_join, packing, pii, quality, runs, sharding, tokens, url_filter

QUERIES = {
    "op1_nearest": nearest.op1_nearest,
    "op2_html_text": html_text.op2_html_text,
    "op3_chat": chat.op3_chat,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_packing": packing.op8_packing,
    "op9_tokens": tokens.op9_tokens,
    "op10_pii": pii.op10_pii,
    "op11_infill": infill.op11_infill,
    "op12_runs": runs.op12_runs,
    "op13_sharding": sharding.op13_sharding,
}

SQL = {
    "op1_nearest": nearest.OP1_SQL,
    "op3_chat": chat.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op10_pii": pii.OP10_SQL,
    "op11_infill": infill.OP11_SQL,
    "op12_runs": runs.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
