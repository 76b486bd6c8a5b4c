"""All queries of the library."""

from . import bpe_queries, cut_queries, english_queries, eval_queries, grammar_queries, hebrew_queries, more_queries, morph_queries, run_queries, set_queries, split_queries, stat_queries, text_queries, turkish_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
