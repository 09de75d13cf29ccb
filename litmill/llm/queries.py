"""The subpackage's queries and their SQL, for the driver's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litmill.llm import chat, chroma, lexical, line_dedup, mixing, neighbours, pii, ppm, quality_rules, repair, sentencepiece_codec, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat": chat.op2_chat,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_pii": pii.op4_pii,
    "op5_simhash": simhash.op5_simhash,
    "op6_ppm": ppm.op6_ppm,
    "op7_mixing": mixing.op7_mixing,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_chroma": chroma.op9_chroma,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_quality": quality_rules.op11_quality,
    "op12_repair": repair.op12_repair,
    "op13_lexical": lexical.op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": chat.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_quality": quality_rules.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
