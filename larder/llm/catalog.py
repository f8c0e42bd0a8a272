"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op01_fingerprint import op1_fingerprint
from .op02_stream_dedup import OP2_SQL, op2_stream_dedup
from .op03_chat import OP3_SQL, op3_chat_format
from .op04_sentencepiece import op4_sentencepiece
from .op05_stupid_backoff import OP5_SQL, op5_stupid_backoff
from .op06_language_id import op6_language_id
from .op07_packing import op7_packing
from .op08_url_filter import OP8_SQL, op8_url_filter
from .op09_minhash import op9_minhash
from .op10_toxicity import op10_toxicity
from .op11_merkle import OP11_SQL, op11_merkle
from .op12_filter_audit import OP12_SQL, op12_filter_audit
from .op13_substring import OP13_SQL, op13_substring

_FUNCTIONS = (
    op1_fingerprint, op2_stream_dedup, op3_chat_format, op4_sentencepiece, op5_stupid_backoff, op6_language_id, op7_packing,
    op8_url_filter, op9_minhash, op10_toxicity, op11_merkle, op12_filter_audit, op13_substring,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
SQL = {
    "op2_stream_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op5_stupid_backoff": OP5_SQL, "op8_url_filter": OP8_SQL,
    "op11_merkle": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_substring": OP13_SQL,
}
