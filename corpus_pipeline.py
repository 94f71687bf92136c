"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, source mixing, BPE encoding.

Each stage works on all that the one before kept; the stages' results are Parquet tables in the shared folder. Rows are told
apart by themselves, not by doc_id; of full ties any one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweave.llm import bpe, exact_dedup, jaccard_join, source_mix, toxicity
from graphweave.llm.common import discard, read, scope, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. A null text is scored as empty; without labels nothing goes."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays; null and empty texts are equal, and a null doc_id is the smallest."""
    return exact_dedup.drop_copies(docs)


def distant(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the smallest doc_id stays; a null one only where no other is linked. Texts without words stay."""
    return jaccard_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once, and those of small sources again up to the repetition limit. A null source is one source."""
    return source_mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix; a null text is empty."""
    return bpe.query(docs)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", distant),
    ("source mix", mixed),
    ("BPE", encoded),
]

#: The classifier, the trie join and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds run() against a
#: composition of plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. A stage's own tables, and the result of the one before, go when its result is written."""
    docs, last = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scope() as made:
            docs, path = written(stage(spark, docs, sf_dir), "stage")
        discard(spark, [*last, *(t for t in made if t != path)])
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
