"""The registered queries of this package and the SQL they are checked with."""

from __future__ import annotations

from bitledger.llm.alignment import op12_alignment
from bitledger.llm.chat import OP4_SQL, op4_chat_format
from bitledger.llm.decontaminate import OP8_SQL, op8_decontaminate
from bitledger.llm.divergence import OP13_SQL, op13_divergence
from bitledger.llm.fingerprints import op7_fingerprints
from bitledger.llm.jaccard_join import OP1_SQL, op1_ngram_jaccard
from bitledger.llm.language import op9_language_id
from bitledger.llm.language_model import op5_lm_scoring
from bitledger.llm.licenses import op10_license_scan
from bitledger.llm.mixing import op6_mixing
from bitledger.llm.quality import op2_quality
from bitledger.llm.quality_rules import OP11_SQL, op11_quality_rules
from bitledger.llm.url_filter import op3_url_filter

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_quality_rules": op11_quality_rules,
    "op12_alignment": op12_alignment,
    "op13_divergence": op13_divergence,
}
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op4_chat_format": OP4_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_quality_rules": OP11_SQL,
    "op13_divergence": OP13_SQL,
}
