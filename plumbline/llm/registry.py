"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from plumbline.llm import (
    op1_language,
    op2_urls,
    op3_jaccard,
    op4_chats,
    op5_html,
    op6_pii,
    op7_pieces,
    op8_exact_dedup,
    op9_neighbours,
    op10_packing,
    op11_codes,
    op12_toxicity,
    op13_clusters,
)

QUERIES = {
    "op1_language": op1_language.op1_language,
    "op2_urls": op2_urls.op2_urls,
    "op3_jaccard": op3_jaccard.op3_jaccard,
    "op4_chats": op4_chats.op4_chats,
    "op5_html": op5_html.op5_html,
    "op6_pii": op6_pii.op6_pii,
    "op7_pieces": op7_pieces.op7_pieces,
    "op8_exact_dedup": op8_exact_dedup.op8_exact_dedup,
    "op9_neighbours": op9_neighbours.op9_neighbours,
    "op10_packing": op10_packing.op10_packing,
    "op11_codes": op11_codes.op11_codes,
    "op12_toxicity": op12_toxicity.op12_toxicity,
    "op13_clusters": op13_clusters.op13_clusters,
}

ORACLES = {
    "op4_chats": op4_chats.ORACLE,
    "op8_exact_dedup": op8_exact_dedup.ORACLE,
    "op11_codes": op11_codes.ORACLE,
    "op13_clusters": op13_clusters.ORACLE,
}
