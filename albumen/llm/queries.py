"""The registered queries of this folder, and their SQL where SQL can express them."""

from albumen.llm import ball_clustering, exact_dedup, fill_in_middle, fingerprint, packing, pii, piece_encoding, sharding, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_piece_encoding": piece_encoding.op2_piece_encoding,
    "op3_warc": warc.op3_warc,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
    "op11_sharding": sharding.op11_sharding,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_ball_clustering": ball_clustering.op13_ball_clustering,
}

ORACLE = {
    "op1_url_filter": url_filter.SQL,
    "op3_warc": warc.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op11_sharding": sharding.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_ball_clustering": ball_clustering.SQL,
}
