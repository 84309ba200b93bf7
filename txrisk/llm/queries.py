"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from txrisk.llm import (chat_format, embed_dedup, merkle, minhash, mixing, packing, prefix_trie, quality,
                        sentencepiece_codec, sharding, suffix_dedup, topk_search, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash": minhash.op1_hyperminhash,
    "op2_temporal_url_lists": url_filter.op2_temporal_url_lists,
    "op3_suffix_merge": suffix_dedup.op3_suffix_merge,
    "op4_jump_sharding": sharding.op4_jump_sharding,
    "op5_bound_search": topk_search.op5_bound_search,
    "op6_neighbour_voting": quality.op6_neighbour_voting,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_int8_tiles": embed_dedup.op8_int8_tiles,
    "op9_prefix_targets": chat_format.op9_prefix_targets,
    "op10_sainte_lague": mixing.op10_sainte_lague,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_merkle_windows": merkle.op12_merkle_windows,
    "op13_best_fit": packing.op13_best_fit,
    "pipeline": corpus_pipeline.run,
}

#: The others are tested against brute force: SQL lacks CRC-32, the tokenizer, models or graph search,
#: or would take hours on whole tables.
SQL: dict[str, str] = {
    "op2_temporal_url_lists": url_filter.OP2_SQL,
    "op5_bound_search": topk_search.OP5_SQL,
    "op9_prefix_targets": chat_format.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_merkle_windows": merkle.OP12_SQL,
}
