"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweave.llm import (
    bpe,
    conversation_trie,
    exact_dedup,
    fuzzy_hash,
    hidden_markov,
    hilbert_shards,
    jaccard_join,
    language_id,
    line_dedup,
    source_divergence,
    source_mix,
    substring_dedup,
    toxicity,
)
from graphweave.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def on_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": on_documents(bpe.query),
        "op2_source_mix": source_mix.query,
        "op3_line_dedup": on_documents(line_dedup.query),
        "op4_jaccard_join": on_documents(jaccard_join.jaccard_join),
        "op5_exact_dedup": on_documents(exact_dedup.exact_dedup),
        "op6_toxicity": lambda spark, d: toxicity.toxicity(read(spark, d, "documents"), read(spark, d, "labels")),
        "op7_language_id": on_documents(language_id.language_id),
        "op8_fuzzy_hash": on_documents(fuzzy_hash.query),
        "op9_hilbert_shards": on_documents(hilbert_shards.hilbert_shards),
        "op10_substring_dedup": on_documents(substring_dedup.query),
        "op11_source_divergence": on_documents(source_divergence.source_divergence),
        "op12_conversation_trie": lambda spark, d: conversation_trie.conversation_trie(read(spark, d, "conversations")),
        "op13_lm_scoring": on_documents(hidden_markov.lm_scores),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL, "op4_jaccard_join": jaccard_join.SQL, "op5_exact_dedup": exact_dedup.SQL, "op10_substring_dedup": substring_dedup.SQL,
        "op11_source_divergence": source_divergence.SQL, "op12_conversation_trie": conversation_trie.SQL,
    }
