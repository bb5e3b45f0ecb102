"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from contextkit.llm.op01_substring import op1_substring_dedup
from contextkit.llm.op02_chat import op2_format_chats
from contextkit.llm.op03_decontaminate import op3_decontaminate
from contextkit.llm.op04_toxicity import op4_toxicity
from contextkit.llm.op05_pii import op5_find_pii
from contextkit.llm.op06_mix import op6_mix_sources
from contextkit.llm.op07_topk import op7_topk_search
from contextkit.llm.op08_pack import op8_pack_tokens
from contextkit.llm.op09_suffix import op9_suffix_dedup
from contextkit.llm.op10_simhash import op10_simhash_dedup
from contextkit.llm.oracles import ORACLES

_ALL = (op1_substring_dedup, op2_format_chats, op3_decontaminate, op4_toxicity, op5_find_pii, op6_mix_sources, op7_topk_search, op8_pack_tokens, op9_suffix_dedup, op10_simhash_dedup)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
