"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.chat_format import op10_chat_formatting
from corpusloom.llm.decontamination import op7_benchmark_decontamination
from corpusloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from corpusloom.llm.language_id import op5_language_id
from corpusloom.llm.line_dedup import OP6_SQL, op6_line_dedup
from corpusloom.llm.manifest import op12_merkle_manifest
from corpusloom.llm.nearest import op9_nearest_neighbours
from corpusloom.llm.quality import op1_quality_classifier
from corpusloom.llm.sentencepiece_codec import op3_sentencepiece
from corpusloom.llm.simhash import op8_simhash_near_dedup
from corpusloom.llm.token_counts import op2_token_counts
from corpusloom.llm.token_output import op13_token_output
from corpusloom.llm.url_filters import OP4_SQL, op4_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_url_filters": op4_url_filters,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_output": op13_token_output,
}

ORACLE_SQL: dict[str, str] = {"op4_url_filters": OP4_SQL, "op6_line_dedup": OP6_SQL, "op11_filter_audit": OP11_SQL}
