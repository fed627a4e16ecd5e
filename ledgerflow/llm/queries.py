"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerflow.llm.bpe import op4
from ledgerflow.llm.language import op9
from ledgerflow.llm.licences import op6
from ledgerflow.llm.mixing import OP3_SQL, op3
from ledgerflow.llm.near_dedup import op2
from ledgerflow.llm.neighbours import op8
from ledgerflow.llm.quality import op10
from ledgerflow.llm.sharding import op7
from ledgerflow.llm.tiff import op1
from ledgerflow.llm.token_counts import op5

QUERIES = {
    "op1_tiff_pages": op1,
    "op2_minmax_dedup": op2,
    "op3_source_mixing": op3,
    "op4_bpe_round_trip": op4,
    "op5_token_counts": op5,
    "op6_licence_scan": op6,
    "op7_slot_sharding": op7,
    "op8_curve_neighbours": op8,
    "op9_language": op9,
    "op10_quality": op10,
}

ORACLES = {"op3_source_mixing": OP3_SQL}
