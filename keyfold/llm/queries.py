"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from keyfold.llm.blocks import OP6_SQL, op6_block_pruning
from keyfold.llm.bpe import op7_word_table_bpe
from keyfold.llm.content_sort import OP10_SQL, op10_content_sort
from keyfold.llm.feistel import op8_feistel_shards
from keyfold.llm.fm import op1_factorisation_machine
from keyfold.llm.ftrl import op3_ftrl_toxicity
from keyfold.llm.jaccard import OP2_SQL, op2_prefix_jaccard
from keyfold.llm.packing import op9_best_two_fit
from keyfold.llm.pii import op4_weak_supervision_pii
from keyfold.llm.urls import op5_association_rules

QUERIES = {
    "op1_factorisation_machine": op1_factorisation_machine,
    "op2_prefix_jaccard": op2_prefix_jaccard,
    "op3_ftrl_toxicity": op3_ftrl_toxicity,
    "op4_weak_supervision_pii": op4_weak_supervision_pii,
    "op5_association_rules": op5_association_rules,
    "op6_block_pruning": op6_block_pruning,
    "op7_word_table_bpe": op7_word_table_bpe,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_content_sort": op10_content_sort,
}

ORACLE_SQL = {
    "op2_prefix_jaccard": OP2_SQL,
    "op6_block_pruning": OP6_SQL,
    "op10_content_sort": OP10_SQL,
}
