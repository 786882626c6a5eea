"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from sheaf.llm import block_search, exact_dedup, jump_shards, mixing, packing, simhash, token_store, toxicity, url_filter, warc

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_packing": packing.op4_packing,
    "op5_mixing": mixing.op5_mixing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_block_search": block_search.op7_block_search,
    "op8_sharding": jump_shards.op8_sharding,
    "op9_simhash": simhash.op9_simhash,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES = {
    "op3_warc": warc.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_block_search": block_search.OP7_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
