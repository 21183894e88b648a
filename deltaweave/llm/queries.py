"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import fingerprint, langid, lines, lm, maxscore, minhash, mixing, pieces, quality, warc
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_topk_search": maxscore.op3_topk_search,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_lm_scores": lm.op6_lm_scores,
    "op7_quality": quality.op7_quality,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_language_id": langid.op9_language_id,
    "op10_warc_revisits": warc.op10_warc_revisits,
}
