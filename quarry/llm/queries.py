"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from quarry.llm.bitplane_clusters import OP12_SQL, op12_bitplane_clusters
from quarry.llm.byte_bpe import op11_byte_bpe
from quarry.llm.chat import OP7_SQL, op7_chat_format
from quarry.llm.decontaminate import OP2_SQL, op2_decontaminate
from quarry.llm.fill_middle import OP13_SQL, op13_fill_middle
from quarry.llm.html_main import op4_html_main
from quarry.llm.jaccard import op9_jaccard_join
from quarry.llm.lang_crf import op1_language_crf
from quarry.llm.line_rules import OP10_SQL, op10_quality_rules
from quarry.llm.mixing import OP6_SQL, op6_mix
from quarry.llm.quality_eb import op3_quality_bayes
from quarry.llm.suffix_dedup import op5_suffix_dedup
from quarry.llm.url_rules import OP8_SQL, op8_url_filter

REGISTRY = {
    "op1_language_crf": op1_language_crf,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_bayes": op3_quality_bayes,
    "op4_html_main": op4_html_main,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mix": op6_mix,
    "op7_chat_format": op7_chat_format,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_bitplane_clusters": op12_bitplane_clusters,
    "op13_fill_middle": op13_fill_middle,
}
ORACLE = {
    "op2_decontaminate": OP2_SQL,
    "op6_mix": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_bitplane_clusters": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
