"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from ponding.llm.class_lm import op13_class_lm
from ponding.llm.decontaminate import op2_suffix_decontamination
from ponding.llm.feistel_shards import op9_feistel_shards
from ponding.llm.jaccard_join import op5_ngram_jaccard_join
from ponding.llm.license_scan import op3_license_scan
from ponding.llm.oracles import ORACLE_SQL  # noqa: F401
from ponding.llm.packing import op10_best_fit_packing
from ponding.llm.prefix_trie import op12_conversation_trie
from ponding.llm.quality_net import op8_byte_network
from ponding.llm.quality_rules import op7_robust_outliers
from ponding.llm.substring_dedup import op1_substring_dedup
from ponding.llm.suffix_dedup import op4_suffix_array_dedup
from ponding.llm.toxicity import op6_toxicity
from ponding.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_suffix_decontamination, op3_license_scan, op4_suffix_array_dedup, op5_ngram_jaccard_join, op6_toxicity, op7_robust_outliers, op8_byte_network, op9_feistel_shards, op10_best_fit_packing, op11_embedding_whitening, op12_conversation_trie, op13_class_lm)}
