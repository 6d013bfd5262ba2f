"""Queries of this subpackage and their SQL."""

from .decontamination import op9_cgk_decontamination
from .line_dedup import OP1_SQL, op1_winnowed_lines
from .ngram_join import op6_ngram_join
from .packing import op4_best_fit_packing
from .quality_classifier import op10_fourier_quality
from .quality_rules import op3_host_rules
from .sharding import op2_jump_sharding
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op8_noisy_or_toxicity
from .warc import OP7_SQL, op7_chained_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_winnowed_lines, op2_jump_sharding, op3_host_rules, op4_best_fit_packing, op5_suffix_dedup,
        op6_ngram_join, op7_chained_warc, op8_noisy_or_toxicity, op9_cgk_decontamination, op10_fourier_quality,
    )
}
SQL = {"op1_winnowed_lines": OP1_SQL, "op7_chained_warc": OP7_SQL}
