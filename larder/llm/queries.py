"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op1_bpe_round_trip
from .decontaminate import OP12_SQL, op12_decontamination
from .fertility import op6_fertility_rules
from .hnsw import op10_nearest_vectors
from .langid import op9_language_id
from .line_dedup import op2_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import OP7_SQL, op7_mix_sources
from .near_dup import op4_near_duplicates
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .suffix_lm import op5_suffix_tree_scores
from .token_store import op3_token_shards
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_line_dedup, op3_token_shards, op4_near_duplicates, op5_suffix_tree_scores, op6_fertility_rules, op7_mix_sources, op8_toxicity, op9_language_id, op10_nearest_vectors, op11_merkle_manifest, op12_decontamination, op13_prefix_trie)}
SQL = {"op7_mix_sources": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_prefix_trie": OP13_SQL}
