"""The queries of this package, by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, html_wrappers, language_model, licenses, mixing, pii, quality, sentencepiece_codec, simhash, toxicity

QUERIES = {
    "op1_toxic_segments": toxicity.query,
    "op2_feistel_pii": pii.query,
    "op3_bloom_lm": language_model.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_license_digests": licenses.query,
    "op6_quality_ledger": quality.query,
    "op7_poisson_mix": mixing.query,
    "op8_simhash_classes": simhash.query,
    "op9_html_wrappers": html_wrappers.query,
    "op10_sentencepiece": sentencepiece_codec.query,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_license_digests": licenses.SQL,
    "op6_quality_ledger": quality.SQL,
    "op7_poisson_mix": mixing.SQL,
}
