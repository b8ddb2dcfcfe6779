"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from siteseries.llm import (exact_dedup, hyper_minhash, lexical_search, line_dedup, merkle_manifest, packing, piece_sampling,
                            quality_classifier, quality_rules, secrets_scan, simhash, token_counts, url_filters)

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_pack_documents": packing.op2_pack_documents,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_sentencepiece_sampling": piece_sampling.op5_sentencepiece_sampling,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_secret_scans": secrets_scan.op10_secret_scans,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_hyper_minhash": hyper_minhash.op13_hyper_minhash,
}
SQL = {"op1_url_filters": url_filters.SQL, "op8_exact_dedup": exact_dedup.SQL, "op11_lexical_search": lexical_search.SQL, "op12_merkle_manifest": merkle_manifest.SQL}
