"""Queries of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op1_audio_features
from .chat import OP13_SQL, op13_chat_format
from .decontaminate import op10_simhash
from .divergence import OP12_SQL, op12_source_audit
from .language import op8_language_id
from .neardup import op7_dartminhash
from .pages import op4_main_text
from .pieces import op2_sentencepiece
from .quality import op6_quality
from .search import OP11_SQL, op11_lexical_search
from .substrings import op5_substrings
from .suffix_tree import op9_suffix_tree
from .toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_audio_features": op1_audio_features,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_toxicity": op3_toxicity,
        "op4_main_text": op4_main_text,
        "op5_substrings": op5_substrings,
        "op6_quality": op6_quality,
        "op7_dartminhash": op7_dartminhash,
        "op8_language_id": op8_language_id,
        "op9_suffix_tree": op9_suffix_tree,
        "op10_simhash": op10_simhash,
        "op11_lexical_search": op11_lexical_search,
        "op12_source_audit": op12_source_audit,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    """The first ten have none: their hashes and models cannot be written as SQL over whole tables in useful time."""
    return {"op11_lexical_search": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_chat_format": OP13_SQL}
