"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import exact_dedup, fill_middle, fingerprints, html_text, language_id, near_dedup, neighbours, packing, pieces, prefix_trie, quality, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_warc": warc.op2_warc,
    "op3_html_text": html_text.op3_html_text,
    "op4_language_id": language_id.op4_language_id,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_quality": quality.op6_quality,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_packing": packing.op8_packing,
    "op9_minhash": near_dedup.op9_minhash,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL = {"op2_warc": warc.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op12_fill_middle": fill_middle.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
