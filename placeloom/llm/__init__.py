"""Operations of a training-data pipeline at scale; nothing else in the library imports them."""

from __future__ import annotations

from placeloom.llm import importance, jaccard_join, lexical, licenses, mixing, packing, quality, sharding, spotsigs, token_records, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_packing": packing.op2_packing,
    "op3_quality": quality.op3_quality,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_topk": topk.op5_topk,
    "op6_mixing": mixing.op6_mixing,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_ngram_jaccard": jaccard_join.op8_ngram_jaccard,
    "op9_sharding": sharding.op9_sharding,
    "op10_token_records": token_records.op10_token_records,
    "op11_importance": importance.op11_importance,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL = {
    "op4_license_scan": licenses.SQL,
    "op5_topk": topk.SQL,
    "op6_mixing": mixing.SQL,
    "op8_ngram_jaccard": jaccard_join.SQL,
    "op11_importance": importance.SQL,
    "op12_lexical_search": lexical.SQL,
}
