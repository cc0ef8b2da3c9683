"""Query keys of this subpackage and their DuckDB SQL (where SQL can say it)."""

from __future__ import annotations

from . import (collocations, decontaminate, html_text, merkle, near_vectors, ngram_join, packing, ppm, secrets, sharding,
               tool_calls, toxicity, url_filter)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_html_text": html_text.op3_html_text,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_near_vectors": near_vectors.op5_near_vectors,
    "op6_packing": packing.op6_packing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_lm_score": ppm.op8_lm_score,
    "op9_secrets": secrets.op9_secrets,
    "op10_tool_calls": tool_calls.op10_tool_calls,
    "op11_merkle": merkle.op11_merkle,
    "op12_sharding": sharding.op12_sharding,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {
    "op2_ngram_join": ngram_join.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_near_vectors": near_vectors.SQL,
    "op10_tool_calls": tool_calls.SQL,
    "op11_merkle": merkle.SQL,
    "op12_sharding": sharding.SQL,
    "op13_collocations": collocations.SQL,
}
