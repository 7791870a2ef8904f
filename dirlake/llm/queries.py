"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op3_chat_format
from .codebooks import op13_vector_codes
from .decontamination import op5_decontamination
from .embeddings import op4_embedding_dedup
from .jaccard import op1_ngram_jaccard
from .langid import op8_language_id
from .lines import op7_line_dedup
from .lm import op10_lm_score
from .packing import op9_packing
from .sql import ORACLE_SQL
from .substrings import op2_suffix_dedup
from .token_files import op6_token_files
from .topk import op12_exact_topk
from .trie import op11_prefix_trie

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_lm_score": op10_lm_score,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_exact_topk": op12_exact_topk,
    "op13_vector_codes": op13_vector_codes,
}
