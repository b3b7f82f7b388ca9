"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from basalt.llm.bpe import op2_bpe_encode_decode
from basalt.llm.language_model import op3_language_model_scores
from basalt.llm.media import op1_media_columns
from basalt.llm.mixing import op6_mix_sources
from basalt.llm.near_vectors import op7_near_vectors
from basalt.llm.quality import op9_quality_classifier
from basalt.llm.repeats import op10_remove_repeats
from basalt.llm.secret_scan import op8_secret_scans
from basalt.llm.shingle_join import op5_shingle_jaccard_join
from basalt.llm.training_order import op4_training_order

QUERIES = {f.__name__: f for f in (op1_media_columns, op2_bpe_encode_decode, op3_language_model_scores, op4_training_order, op5_shingle_jaccard_join, op6_mix_sources, op7_near_vectors, op8_secret_scans, op9_quality_classifier, op10_remove_repeats)}
ORACLE_SQL: dict[str, str] = {}
