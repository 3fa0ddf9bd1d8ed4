"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import CHAT_SQL, op3_chat_format
from .decontaminate import op2_decontaminate
from .html_extract import op5_html_extract
from .language_id import op10_language_id
from .license_scan import op6_license_scan
from .merkle import op8_merkle
from .packing import op7_packing
from .ppm import op9_ppm
from .prefix_trie import TRIE_SQL, op11_prefix_trie
from .quality_rules import op13_quality_rules
from .simhash import op1_simhash
from .suffix_dedup import op4_suffix_dedup
from .whitening import op12_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_html_extract": op5_html_extract,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_merkle": op8_merkle,
    "op9_ppm": op9_ppm,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {"op3_chat_format": CHAT_SQL, "op11_prefix_trie": TRIE_SQL}
