"""Queries of this subpackage and their SQL, for the driver's contract."""
from __future__ import annotations

from .ann import op4
from .bpe import op3
from .language import op9
from .licenses import OP7_SQL, op7
from .near_dup import op6
from .packing import op10
from .pieces import op13
from .prefix_trie import OP11_SQL, op11
from .quality import op1
from .token_counts import op5
from .top_k import OP2_SQL, op2
from .url_filter import OP8_SQL, op8
from .whitening import op12

QUERIES = {
    "op1_quality_classifier": op1,
    "op2_maxscore_top_k": op2,
    "op3_bpe_forced_boundaries": op3,
    "op4_one_bit_neighbours": op4,
    "op5_trie_token_counts": op5,
    "op6_chosen_path_near_duplicates": op6,
    "op7_license_scan": op7,
    "op8_url_filter": op8,
    "op9_language_id": op9,
    "op10_cost_balanced_packing": op10,
    "op11_centroid_prefix_trie": op11,
    "op12_chebyshev_whitening": op12,
    "op13_agenda_pieces": op13,
}

ORACLE = {"op2_maxscore_top_k": OP2_SQL, "op7_license_scan": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_centroid_prefix_trie": OP11_SQL}
