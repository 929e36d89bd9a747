"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import articles, bpe, exact, infill, langid, licenses, lots, mixing, near, ppm, quality, repeats, urls

QUERIES = {
    "op1_ppm_score": ppm.op1_ppm_score,
    "op2_suffix_repeats": repeats.op2_suffix_repeats,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_minhash_near": near.op7_minhash_near,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_language_id": langid.op9_language_id,
    "op10_url_filter": urls.op10_url_filter,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_html_articles": articles.op12_html_articles,
    "op13_return_lots": lots.op13_return_lots,
}

ORACLE_SQL = {
    "op2_suffix_repeats": repeats.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op6_exact_dedup": exact.OP6_SQL,
    "op7_minhash_near": near.OP7_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op9_language_id": langid.OP9_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
    "op13_return_lots": lots.OP13_SQL,
}
