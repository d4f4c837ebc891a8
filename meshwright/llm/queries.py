"""The text operators' queries and, where SQL can express one, the SQL that must agree."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .bpe import op6_byte_bpe
from .chat import SQL as CHAT_SQL
from .chat import op3_chat_formatting
from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op11_source_divergence
from .fingerprints import op4_fingerprints
from .jaccard import SQL as JACCARD_SQL
from .jaccard import op5_ngram_jaccard
from .mixing import SQL as MIXING_SQL
from .mixing import op12_source_mixing
from .packing import op10_best_fit_packing
from .pii import op1_pii
from .quality import op9_quality_resampling
from .secrets import op2_secrets
from .sharding import op7_sharding
from .topk import SQL as TOP_K_SQL
from .topk import op8_exact_top_k

QUERIES = {
    "op1_pii": op1_pii,
    "op2_secrets": op2_secrets,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_fingerprints": op4_fingerprints,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_sharding": op7_sharding,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_quality_resampling": op9_quality_resampling,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_source_mixing": op12_source_mixing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
SQL: dict[str, str] = {"op3_chat_formatting": CHAT_SQL, "op5_ngram_jaccard": JACCARD_SQL, "op8_exact_top_k": TOP_K_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_source_mixing": MIXING_SQL}
