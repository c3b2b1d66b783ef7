"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .html_extract import op1_html_extract
from .image_copies import op6_image_copies
from .mixing import op9_mixing
from .near_dedup import OP5_SQL, op5_near_dedup
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .token_count import op2_token_count
from .toxicity import op4_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_token_count": op2_token_count,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_image_copies": op6_image_copies,
    "op7_warc": op7_warc,
    "op8_chat_format": op8_chat_format,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL = {
    "op7_warc": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op5_near_dedup": OP5_SQL,
    "op3_substring_dedup": OP3_SQL,
}
