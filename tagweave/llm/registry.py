"""The folder's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import exact_dedup, fill_in_middle, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, rules, sharding, simhash, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_packing": packing.op10_packing,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_ngram_jaccard_join": ngram_join.op13_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {**exact_dedup.SQL, **fill_in_middle.SQL, **ngram_join.SQL}
