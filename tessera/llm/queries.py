"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import sql
from tessera.llm.chat import op9_chat
from tessera.llm.chunked_bpe import op5_bpe
from tessera.llm.html_text import op1_html_text
from tessera.llm.jaccard import op2_jaccard
from tessera.llm.media import op10_media
from tessera.llm.packing import op6_pack
from tessera.llm.pu_quality import op3_pu_quality
from tessera.llm.quality_rules import op4_quality_rules
from tessera.llm.secret_scan import op8_secret_scan
from tessera.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_jaccard": op2_jaccard,
    "op3_pu_quality": op3_pu_quality,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe": op5_bpe,
    "op6_pack": op6_pack,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat": op9_chat,
    "op10_media": op10_media,
}

#: The other queries learn models, encode, or write media, which SQL cannot express.
SQL: dict[str, str] = {"op2_jaccard": sql.JACCARD, "op8_secret_scan": sql.secrets(), "op9_chat": sql.CHAT}
