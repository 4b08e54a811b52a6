"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from .alignment import op13_cross_tokenizer_alignment
from .chunk_store import op4_content_addressed_ids
from .conversation_repair import op12_conversation_repair
from .decontamination import op2_benchmark_decontamination
from .license_scan import op3_license_scan
from .line_dedup import op10_line_dedup
from .packing import op6_power_of_two_packing
from .pieces import op11_piece_round_trip
from .quality import op1_pu_quality
from .scaled_sketch import op7_scaled_sketch
from .simhash_dedup import op5_simhash_near_dedup
from .suffix_tree_lm import op9_suffix_tree_score
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_pu_quality,
        op2_benchmark_decontamination,
        op3_license_scan,
        op4_content_addressed_ids,
        op5_simhash_near_dedup,
        op6_power_of_two_packing,
        op7_scaled_sketch,
        op8_toxicity,
        op9_suffix_tree_score,
        op10_line_dedup,
        op11_piece_round_trip,
        op12_conversation_repair,
        op13_cross_tokenizer_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {}
