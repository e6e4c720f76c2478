"""The queries that __spark_entry__ registers for this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat import SQL as OP8_SQL
from .chat import op8_chat
from .lines import op7_lines
from .media import op5_media
from .mixing import op1_mixing
from .ngrams import op2_ngram_join
from .secrets import op4_secrets
from .sharding import op3_sharding
from .topk import SQL as OP10_SQL
from .topk import op10_topk
from .toxicity import op9_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_media": op5_media,
    "op6_bpe": op6_bpe,
    "op7_lines": op7_lines,
    "op8_chat": op8_chat,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
}

ORACLES = {"op8_chat": OP8_SQL, "op10_topk": OP10_SQL}
