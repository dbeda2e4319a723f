"""Registered queries of this subpackage; the pipeline over them is registered with it by the driver contract."""

from __future__ import annotations

from .balanced_packing import op13_balanced_packing
from .decontaminate import op6_decontaminate
from .dedup import op2_suffix_dedup
from .lm_scoring import op4_lm_scoring
from .merkle import OP12_SQL, op12_merkle
from .packing import op7_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import OP9_SQL, op9_quality
from .simhash import op10_simhash
from .token_counts import op5_token_counts
from .token_files import op3_token_files
from .toxicity import op1_toxicity
from .warc import OP8_SQL, op8_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_token_files, op4_lm_scoring, op5_token_counts, op6_decontaminate, op7_packing, op8_warc, op9_quality, op10_simhash, op11_prefix_trie, op12_merkle, op13_balanced_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op9_quality": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle": OP12_SQL}
