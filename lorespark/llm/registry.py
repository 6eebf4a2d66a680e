"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import pipeline
from .align import op11_align_tokenizers
from .bpe import op8_byte_bpe
from .chat import OP12_SQL, op12_chat_format
from .classifier import op4_quality_classifier
from .decontaminate import op10_decontamination
from .html_text import op6_html_text
from .jaccard import OP1_SQL, op1_jaccard_join
from .quality_rules import OP9_SQL, op9_quality_rules
from .repeats import OP3_SQL, op3_repeats
from .secrets import op7_secrets
from .sharding import OP5_SQL, op5_sharding
from .token_counts import op2_token_counts
from .trie import OP13_SQL, op13_conversation_trie

QUERIES = {
    "pipeline": pipeline.run,
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_repeats": op3_repeats,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sharding": op5_sharding,
    "op6_html_text": op6_html_text,
    "op7_secrets": op7_secrets,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_chat_format": op12_chat_format,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op3_repeats": OP3_SQL, "op5_sharding": OP5_SQL, "op9_quality_rules": OP9_SQL, "op12_chat_format": OP12_SQL, "op13_conversation_trie": OP13_SQL}
