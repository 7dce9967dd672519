"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .decontam import OP5_SQL, op5_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .jaccard import OP7_SQL, op7_ngram_jaccard_join
from .line_dedup import op9_line_dedup
from .packing import op3_packing
from .sharding import op6_sharding
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op2_toxicity
from .url_filter import op1_url_filter


def queries():
    each = (op1_url_filter, op2_toxicity, op3_packing, op4_token_counts, op5_decontamination, op6_sharding, op7_ngram_jaccard_join, op8_exact_dedup, op9_line_dedup, op10_substring_dedup)
    return {f.__name__: f for f in each}


def oracle_sql():
    return {"op5_decontamination": OP5_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_substring_dedup": OP10_SQL}
