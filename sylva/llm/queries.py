"""The queries over whole tables that the driver runs, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op2_bpe
from .classifier import op7_quality_classifier
from .fingerprints import op10_fingerprints
from .line_dedup import op8_line_dedup
from .mixing import op1_mixing
from .ngram_join import OP6_SQL, op6_ngram_join
from .quality_rules import OP9_SQL, op9_quality_rules
from .sharding import op5_sharding
from .substring_dedup import op4_substring_dedup
from .token_counts import op3_token_counts

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op6_ngram_join": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
}
