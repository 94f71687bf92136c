"""Shared helpers: intermediate tables in the shared folder, ASCII-only lower case, input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.plans.tables import discard, materialise, scope, shared_dir, written

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "ascii_lower", "bounded_sample", "discard", "documents", "frequent", "materialise", "read", "scope", "shared_dir", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of every word and line rule here: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the fast way for texts without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named in more; other columns never get further."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Sketches that meet in one task.
FAN_IN = 32


def frequent(rows: DataFrame, column: str, support: float) -> DataFrame:
    """item: 64-bit hashes of the column, among them those of all values that more than `support` of the rows have; about
    1 / support of them at most.

    Each task makes a Misra-Gries sketch (in the form of Apache DataSketches, whose error is 3.5 / its size), sketches are
    merged FAN_IN at a time in as many levels as that takes, and what is under the bound is dropped.
    """
    tracked = min(1_000_000, int(8 / support) + 1)
    groups, least = rows.rdd.getNumPartitions(), support * rows.count()
    group, sketch = F.spark_partition_id(), F.expr(f"approx_top_k_accumulate(xxhash64({column}), {tracked})")
    merged = rows
    while True:
        groups = max(1, -(-groups // FAN_IN))
        merged = merged.groupBy((group % groups).alias("group")).agg(sketch.alias("sketch"))
        if groups == 1:
            break
        group, sketch = F.col("group"), F.expr(f"approx_top_k_combine(sketch, {tracked})")
    return merged.select(F.inline(F.expr(f"approx_top_k_estimate(sketch, {min(tracked, int(2 / support) + 1)})"))).where(F.col("count") >= least).select("item")


def bounded_sample(rows: DataFrame, share: float, most: int, most_bytes: int) -> DataFrame:
    """doc_id, text, text_hash and the other columns of at most 2 * `most` rows whose texts have most_bytes together; about a
    share of all rows, drawn by a hash of doc_id.

    They are taken in the order of that hash, those that the bytes left have room for, so that a rerun takes the same. A
    text that repeats under its doc_id is taken once.
    """
    drawn = rows.withColumn("text_hash", F.xxhash64("text"))
    if share < 1:
        drawn = drawn.where(F.call_function("shiftrightunsigned", F.xxhash64("doc_id", F.lit(7)), F.lit(1)) < F.lit(int(share * 2**63)))
    key = ["doc_id", "text_hash"]
    slim = drawn.groupBy(*key).agg(F.max(F.octet_length("text")).alias("bytes")).orderBy(F.xxhash64("doc_id", F.lit(7)), *key).limit(2 * most)
    left, taken = most_bytes, []
    for doc_id, text_hash, size in slim.collect():  # 2 * most rows of three numbers
        if size <= left:
            left -= size
            taken.append((doc_id, text_hash))
    keys = rows.sparkSession.createDataFrame(taken, drawn.select(*key).schema)
    return drawn.join(F.broadcast(keys), key).dropDuplicates(key)
