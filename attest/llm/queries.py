"""The queries of this subpackage and the DuckDB SQL that checks those SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontam, fmindex, langid, mixing, neardup, quality, suffixes, topk, toxicity
from .oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_top_k": topk.op8_top_k,
    "op9_substring_dedup": fmindex.op9_substring_dedup,
    "op10_language_id": langid.op10_language_id,
    "pipeline": corpus_pipeline.run,
}

