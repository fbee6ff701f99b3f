"""Queries and SQL of the subpackage, by name."""

from millrace.llm import bpe_automaton, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, packing, prefix_trie, signature_search, token_counts, toxicity, warc

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_arc_to_warc": warc.query,
    "op5_best_fit_packing": packing.query,
    "op6_license_scan": license_scan.query,
    "op7_toxicity": toxicity.query,
    "op8_language_id": language_id.query,
    "op9_decontaminate": decontaminate.query,
    "op10_line_dedup": line_dedup.query,
    "op11_bpe_automaton": bpe_automaton.query,
    "op12_signature_search": signature_search.query,
    "op13_prefix_trie": prefix_trie.query,
}

SQL = {
    "op2_jaccard_join": jaccard_join.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_arc_to_warc": warc.SQL,
    "op6_license_scan": license_scan.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op12_signature_search": signature_search.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
