"""Queries of this subpackage for the driver."""

from .blocknames import OP8_SQL, op8_exact_dedup
from .decontaminate import OP10_SQL, op10_decontamination
from .mixing import op1_mixing
from .ngramjoin import OP3_SQL, op3_ngram_join
from .personal import op2_personal_data
from .quality import op4_quality
from .repeats import op7_repeats
from .sharding import op6_sharding
from .suffixtree import op5_suffix_tree_scores
from .tokencount import op9_token_counts

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_personal_data": op2_personal_data,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_suffix_tree_scores": op5_suffix_tree_scores,
    "op6_sharding": op6_sharding,
    "op7_repeats": op7_repeats,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {
    "op3_ngram_join": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_decontamination": OP10_SQL,
}
