"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismframe.llm.bm25 import op1_bm25_search
from prismframe.llm.chat import OP7_SQL, op7_chat_format
from prismframe.llm.dual_tree import OP12_SQL, op12_dual_tree_search
from prismframe.llm.html_text import op9_html_main_text
from prismframe.llm.jaccard_join import op6_ngram_jaccard_join
from prismframe.llm.mixing import op3_mix_sources
from prismframe.llm.packing import op10_best_fit_packing
from prismframe.llm.pii import op5_contextual_pii
from prismframe.llm.quality import op4_quality_llr
from prismframe.llm.simhash import op13_simhash
from prismframe.llm.substring_dedup import op2_repeated_passages
from prismframe.llm.urls import op8_url_filter
from prismframe.llm.whitening import op11_whiten


QUERIES = (
    op1_bm25_search, op2_repeated_passages, op3_mix_sources, op4_quality_llr, op5_contextual_pii, op6_ngram_jaccard_join, op7_chat_format,
    op8_url_filter, op9_html_main_text, op10_best_fit_packing, op11_whiten, op12_dual_tree_search, op13_simhash,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": OP7_SQL, "op12_dual_tree_search": OP12_SQL}
