"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import jaccard, langid, licenses, minhash, mixing, mixture, ogg, periodic, pieces, polytope, repeats, tiers, warc

QUERIES = {
    "op1_ogg_media": ogg.op1,
    "op2_context_mixing": mixing.op2,
    "op3_ngram_jaccard": jaccard.op3,
    "op4_warc_transactions": warc.op4,
    "op5_license_scan": licenses.op5,
    "op6_substring_dedup": repeats.op6,
    "op7_sentencepiece": pieces.op7,
    "op8_order_minhash": minhash.op8,
    "op9_language_id": langid.op9,
    "op10_mixture": mixture.op10,
    "op11_periodic_runs": periodic.op11,
    "op12_embedding_near_dedup": polytope.op12,
    "op13_tiered_search": tiers.op13,
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": jaccard.ORACLE,
    "op4_warc_transactions": warc.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op6_substring_dedup": repeats.ORACLE,
    "op10_mixture": mixture.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_embedding_near_dedup": polytope.ORACLE,
    "op13_tiered_search": tiers.ORACLE,
}
