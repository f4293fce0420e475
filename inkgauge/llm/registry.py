"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .hard_negatives import OP13_SQL, op13_hard_negatives
from .jaccard_join import op10_jaccard_join
from .language_id import op12_language_id
from .line_dedup import OP5_SQL, op5_line_dedup
from .media import op7_media_columns
from .one_bit_search import OP8_SQL, op8_one_bit_search
from .packing import op2_best_fit_packing
from .piece_codec import op1_piece_codec
from .ranked_search import OP11_SQL, op11_ranked_search
from .secrets import OP4_SQL, op4_secret_scans
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity
from .url_filters import OP9_SQL, op9_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scans": op4_secret_scans,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_media_columns": op7_media_columns,
    "op8_one_bit_search": op8_one_bit_search,
    "op9_url_filters": op9_url_filters,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_language_id": op12_language_id,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op4_secret_scans": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_one_bit_search": OP8_SQL,
    "op9_url_filters": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
