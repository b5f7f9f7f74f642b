"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op2_chat
from .decontaminate import op6_decontaminate
from .lm import op7_lm_scoring
from .neardup import op4_neardup
from .oracles import ORACLE_SQL
from .packing import op1_packing
from .quality import op8_quality
from .secrets import op5_secrets
from .sharding import op9_sharding
from .substrings import op3_substrings
from .toxicity import op10_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_substrings": op3_substrings,
    "op4_neardup": op4_neardup,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
