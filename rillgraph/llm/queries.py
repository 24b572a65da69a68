"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat
from .embedding_dedup import OP6_SQL, op6_embedding_dedup
from .fingerprints import op4_fingerprints
from .mixing import op8_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .packing import op5_packing
from .pii import op9_pii
from .quality import op3_quality
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_chat, op3_quality, op4_fingerprints, op5_packing, op6_embedding_dedup, op7_toxicity, op8_mixing, op9_pii, op10_suffix_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op2_chat": OP2_SQL, "op6_embedding_dedup": OP6_SQL}
