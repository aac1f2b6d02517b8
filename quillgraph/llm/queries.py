"""The operators' queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.bpe import op5_bpe
from quillgraph.llm.decontamination import op3_decontamination
from quillgraph.llm.language import op6_language
from quillgraph.llm.language_model import op1_lm
from quillgraph.llm.lines import op2_lines
from quillgraph.llm.near_dedup import op7_near_dedup
from quillgraph.llm.oracle import ORACLE_SQL
from quillgraph.llm.quality import op8_quality
from quillgraph.llm.sharding import op9_sharding
from quillgraph.llm.substrings import op10_substrings
from quillgraph.llm.warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_lines": op2_lines,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_language": op6_language,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_substrings": op10_substrings,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
