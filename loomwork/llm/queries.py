"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomwork.llm.bpe import op2_bpe
from loomwork.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from loomwork.llm.line_dedup import OP3_SQL, op3_line_dedup
from loomwork.llm.minhash import OP1_SQL, op1_minhash_dedup
from loomwork.llm.mixing import OP5_SQL, op5_mix_sources
from loomwork.llm.pii import op8_pii
from loomwork.llm.quality import op10_quality
from loomwork.llm.spotsigs import op4_spot_fingerprints
from loomwork.llm.suffix_dedup import op9_suffix_dedup
from loomwork.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_spot_fingerprints": op4_spot_fingerprints,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op1_minhash_dedup": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op5_mix_sources": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
}
