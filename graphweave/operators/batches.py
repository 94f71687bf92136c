"""Replies for whole batches, given back to the items that were asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.functions.replies import decode

# Fixed value: evidence from here on is enough to propose on.
ENOUGH = 0.6


def rekeyed(inputs: DataFrame, replies: DataFrame, item: T.StructType, key: str, check: Column | None = None, fallback: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """batch, id, outcome, item: one row per input (batch, id), whatever the batch's reply (batch, reply: `{"results": [...]}` of
    such items) holds; and batch, id of results that no input asked for.

    Outcomes: taken; refused (there is no reply, or it can't be decoded: the whole batch); missing (no result has the id);
    rejected (check, a condition on `item`, does not hold). Of results that repeat an id the last counts. What is not taken gets
    the fallback, a struct over the input's columns. A repeated input gets the same item again.
    """
    schema = T.StructType([T.StructField("results", T.ArrayType(item, False), False)])
    one = replies.groupBy("batch").agg(F.max("reply").alias("reply"))  # a batch has one reply
    got = one.select("batch", decode(F.col("reply"), schema).alias("decoded"))
    each = got.select("batch", F.posexplode("decoded.results").alias("pos", "item")).groupBy("batch", F.col(f"item.{key}").alias("id")).agg(F.max_by("item", "pos").alias("item"))
    read = got.where("decoded is not null").select("batch", F.lit(True).alias("__read"))
    rows = inputs.join(read, "batch", "left").join(each, ["batch", "id"], "left")
    good = F.lit(True) if check is None else F.coalesce(check, F.lit(False))
    outcome = F.when(F.col("__read").isNull(), "refused").when(F.col("item").isNull(), "missing").when(~good, "rejected").otherwise("taken")
    free = T.StructType([T.StructField(f.name, f.dataType, True) for f in item.fields])
    other = F.lit(None).cast(free) if fallback is None else fallback.cast(free)
    out = rows.withColumn("outcome", outcome).select("batch", "id", "outcome", F.when(F.col("outcome") == "taken", F.col("item").cast(free)).otherwise(other).alias("item"))
    return out, each.join(inputs, ["batch", "id"], "left_anti").select("batch", "id")


def routed(score: Column) -> Column:
    """Where an item goes on: proposed where its evidence is enough, retrieved for where it is not."""
    return F.when(F.coalesce(score, F.lit(0.0)) >= ENOUGH, "propose").otherwise("retrieve")
