"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, langid, merkle, minhash, packing, pii, secrets, tokencount, toxicity

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_packing": packing.op2_packing,
    "op3_fingerprints": merkle.op3_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_language_id": langid.op8_language_id,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
}
SQL = {"op9_exact_dedup": exact_dedup.OP9_SQL}
