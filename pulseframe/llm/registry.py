"""Queries of this subpackage, and the SQL of those that SQL can express."""

from . import ann, config_lp, conversations, exact_dedup, html_extract, lexical, mixing, near_dedup, packing, repeats, sharding, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_entropy_mix": mixing.op2_entropy_mix,
    "op3_suffix_repeats": repeats.op3_suffix_repeats,
    "op4_vector_packing": packing.op4_vector_packing,
    "op5_near_url_text": html_extract.op5_near_url_text,
    "op6_warc_dictionary": warc.op6_warc_dictionary,
    "op7_chosen_path": near_dedup.op7_chosen_path,
    "op8_cross_polytope": ann.op8_cross_polytope,
    "op9_pattern_toxicity": toxicity.op9_pattern_toxicity,
    "op10_ring_shards": sharding.op10_ring_shards,
    "op11_config_lp": config_lp.op11_config_lp,
    "op12_limited_accumulators": lexical.op12_limited_accumulators,
    "op13_checkpointed_repair": conversations.op13_checkpointed_repair,
}
SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_suffix_repeats": repeats.OP3_SQL,
    "op6_warc_dictionary": warc.OP6_SQL,
    "op7_chosen_path": near_dedup.OP7_SQL,
    "op12_limited_accumulators": lexical.OP12_SQL,
    "op13_checkpointed_repair": conversations.OP13_SQL,
}
