"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import ORACLE_OP4, op4_chat_formatting
from .embeddings import ORACLE_OP6, op6_embedding_near_dedup
from .lm import ORACLE_OP1, op1_lm_scoring
from .minhash import op5_minhash_near_dedup
from .packing import op10_packing
from .pieces import op9_sentencepiece
from .quality import op3_quality_classifier
from .rules import ORACLE_OP8, op8_quality_rules
from .token_counts import op2_token_counts
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_token_counts, op3_quality_classifier, op4_chat_formatting, op5_minhash_near_dedup, op6_embedding_near_dedup, op7_toxicity, op8_quality_rules, op9_sentencepiece, op10_packing)}
ORACLE: dict[str, str] = {"op1_lm_scoring": ORACLE_OP1, "op4_chat_formatting": ORACLE_OP4, "op6_embedding_near_dedup": ORACLE_OP6, "op8_quality_rules": ORACLE_OP8}
