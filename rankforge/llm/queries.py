"""One query for each operator, over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_format
from .decontam import OP10_SQL, op10_decontamination
from .line_dedup import op2_line_dedup
from .minhash import op3_minhash_dedup
from .lm import op8_lm_score
from .mixing import op9_mixing
from .pii import op4_pii
from .quality import OP7_SQL, op7_quality_rules
from .substring import OP6_SQL, op6_substring_dedup
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_pii": op4_pii,
    "op5_chat_format": op5_chat_format,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_score": op8_lm_score,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op10_decontamination": OP10_SQL,
}
