"""Queries and DuckDB SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

#: query name -> module that holds the function of that name, and ``SQL`` where DuckDB can express it
_QUERIES = {
    "op1_substring_sam": "rankloom.llm.substring_sam",
    "op2_warc_zip": "rankloom.llm.warc_zip",
    "op3_imatch": "rankloom.llm.imatch",
    "op4_pii_crf": "rankloom.llm.pii_crf",
    "op5_mix_sources": "rankloom.llm.mixing",
    "op6_suffix_bwt": "rankloom.llm.suffix_bwt",
    "op7_chat_format": "rankloom.llm.chat_format",
    "op8_pack_documents": "rankloom.llm.packing",
    "op9_minhash_join": "rankloom.llm.minhash_join",
    "op10_quality_mcd": "rankloom.llm.quality_mcd",
    "op11_toivonen_phrases": "rankloom.llm.toivonen",
    "op12_impact_search": "rankloom.llm.impact_search",
    "op13_prefix_trie": "rankloom.llm.prefix_trie",
}


def load_all() -> dict:
    out = {}
    for name, module in _QUERIES.items():
        m = importlib.import_module(module)
        out[name] = (getattr(m, name), getattr(m, "SQL", None))
    pipeline = importlib.import_module("corpus_pipeline")
    out["pipeline"] = (pipeline.run, pipeline.ORACLE_SQL)
    return out
