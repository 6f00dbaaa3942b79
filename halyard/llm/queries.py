"""The operators' queries over the driver's tables, and their DuckDB SQL where SQL can express them."""

from halyard.llm import bpe_automaton, langid, minhash, packing, quality, token_counts, token_files, topk, toxicity, url_filter

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_topk": topk.op4_topk,
    "op5_quality": quality.op5_quality,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_token_files": token_files.op7_token_files,
    "op8_language": langid.op8_language,
    "op9_bpe": bpe_automaton.op9_bpe,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLE = {
    "op2_packing": packing.oracle(),
    "op4_topk": topk.ORACLE,
    "op5_quality": quality.oracle(),
    "op10_url_filter": url_filter.ORACLE,
}
