"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP8_SQL, op8_chat_format
from .common import table
from .compression_quality import op3_quality_classifier
from .dart_minhash import op4_near_duplicates
from .decontaminate import OP9_SQL, op9_decontaminate
from .line_crf import op6_line_crf
from .repeat_anchors import OP12_SQL, op12_substring_dedup
from .reshard import op10_reshard
from .suffix_pieces import op2_sentencepiece
from .surrogates import op5_surrogates
from .token_alignment import op13_token_alignment
from .token_counts import op1_token_counts
from .url_automaton import OP7_SQL, op7_url_filter
from .whitening import op11_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": lambda s, d: op1_token_counts(s, table(s, d, "documents")),
        "op2_sentencepiece": lambda s, d: op2_sentencepiece(s, table(s, d, "documents")),
        "op3_quality_classifier": lambda s, d: op3_quality_classifier(s, table(s, d, "documents"), table(s, d, "labels")),
        "op4_near_duplicates": lambda s, d: op4_near_duplicates(s, table(s, d, "documents")),
        "op5_surrogates": lambda s, d: op5_surrogates(s, table(s, d, "documents")),
        "op6_line_crf": lambda s, d: op6_line_crf(s, table(s, d, "documents"), table(s, d, "labels")),
        "op7_url_filter": lambda s, d: op7_url_filter(s, table(s, d, "pages")),
        "op8_chat_format": lambda s, d: op8_chat_format(s, table(s, d, "conversations")),
        "op9_decontaminate": lambda s, d: op9_decontaminate(s, table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_reshard": lambda s, d: op10_reshard(s, table(s, d, "documents")),
        "op11_embedding_whitening": lambda s, d: op11_embedding_whitening(s, table(s, d, "embeddings")),
        "op12_substring_dedup": lambda s, d: op12_substring_dedup(s, table(s, d, "documents")),
        "op13_token_alignment": lambda s, d: op13_token_alignment(s, table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_decontaminate": OP9_SQL, "op12_substring_dedup": OP12_SQL}
