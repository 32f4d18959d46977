"""The registered queries of this subpackage and the same as SQL, where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from tablecheck.llm import (
    divergence, exact_dedup, fill_middle, html_text, language, mixing, near_dedup, packing, sharding, substring_dedup,
    suffix_dedup, topk_search, warc,
)

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_language": language.op2_language,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_packing": packing.op8_packing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_divergence": divergence.op11_divergence,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_topk_search": topk_search.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.SQL,
    "op11_divergence": divergence.SQL,
    "op12_fill_middle": fill_middle.SQL,
    "op13_suffix_dedup": suffix_dedup.SQL,
}
