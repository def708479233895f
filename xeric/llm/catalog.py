"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, licenses, line_dedup, minhash, mixing, pages, secrets, token_counts, toxicity, vector_dedup, whitening


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op10_vector_dedup": vector_dedup.op10_vector_dedup,
        "op11_page_texts": pages.op11_page_texts,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_minhash": minhash.op4_minhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_mixing": mixing.op6_mixing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_secret_scan": secrets.op9_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": divergence.OP12_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL, "op7_line_dedup": line_dedup.OP7_SQL}
