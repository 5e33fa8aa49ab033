"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from meshframe.llm import bpe, exact_dedup, html_text, media, merkle, mixing, near_dedup, packing, quality, token_files, toxicity, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_media": media.op3_media,
    "op4_html_text": html_text.op4_html_text,
    "op5_bpe": bpe.op5_bpe,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_token_files": token_files.op10_token_files,
    "op11_merkle": merkle.op11_merkle,
    "op12_whitening": whitening.op12_whitening,
    "op13_packing": packing.op13_packing,
}

SQL = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op8_mix_sources": mixing.OP8_SQL, "op9_near_dedup": near_dedup.OP9_SQL, "op11_merkle": merkle.OP11_SQL}
