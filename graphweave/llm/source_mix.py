"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power alpha, normalised. alpha is found by repeated
sectioning: each pass evaluates a grid of exponents in one aggregation over the per-source totals and keeps
the bracket in which the limit is met, so the number of sources never matters to the driver. Weights are
realised as epochs over permuted blocks: whole epochs take each block once, and the last, partial epoch
takes its permutation's first blocks up to the token budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import WORD, documents, materialise, read

MAX_REPEATS = 1.5
BLOCKS = 4096
SEED = 17


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens (words of the whole text), block."""
    return documents(docs, "source").select(
        "doc_id",
        "source",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens"),
        F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(BLOCKS)).alias("block"),
    )


def temperature(totals: DataFrame, max_repeats: float | None, entropy: float | None, grid: int = 32, passes: int = 5) -> tuple[float, float]:
    """The exponent from 0 to 1 and the sum of (tokens / most tokens) to that power.

    With max_repeats the smallest exponent whose most repeated source is seen that often at most; with
    entropy (in nats) the largest whose weights have at least that entropy, or 0.
    """
    low, high, total = 0.0, 1.0, 1.0
    ratio = F.col("tokens") / F.col("__most")
    most = totals.agg(F.max("tokens"), F.min("tokens")).first()
    if not most[0]:
        return 1.0, 1.0
    rows = totals.where("tokens > 0").withColumn("__most", F.lit(float(most[0])))
    for _ in range(passes):
        at = [low + (high - low) * i / grid for i in range(grid + 1)]
        sums = rows.agg(
            *[F.sum(F.pow(ratio, F.lit(a))).alias(f"s{i}") for i, a in enumerate(at)],
            *[F.sum(F.pow(ratio, F.lit(a)) * F.log(ratio)).alias(f"l{i}") for i, a in enumerate(at)],
            F.min(ratio).alias("least"),
        ).first()
        if max_repeats is not None:
            fits = [sums["least"] ** (a - 1) <= max_repeats + 1e-12 for a in at]
            k = fits.index(True) if True in fits else grid
            low, high = at[max(k - 1, 0)], at[k]
            best, total = high, sums[f"s{k}"]
        else:
            fits = [math.log(sums[f"s{i}"]) - a * sums[f"l{i}"] / sums[f"s{i}"] >= (entropy or 0) for i, a in enumerate(at)]
            k = max([i for i, ok in enumerate(fits) if ok], default=0)
            low, high = at[k], at[min(k + 1, grid)]
            best, total = low, sums[f"s{k}"]
    return best, total


def place(block: Column, source: Column, epoch: Column) -> Column:
    """The block's place in the epoch's permutation of its source's blocks: an affine map with an odd factor."""
    a = F.pmod(F.xxhash64(F.lit(SEED + 1), source, epoch), F.lit(BLOCKS // 2)) * 2 + 1
    return F.pmod(block * a + F.pmod(F.xxhash64(F.lit(SEED + 2), source, epoch), F.lit(BLOCKS)), F.lit(BLOCKS))


def source_weights(rows: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """source, tokens, weight, epochs, whole, places: one row per source. budget is in tokens; by default
    the least at which the largest source is seen once whole, so that no document is lost."""
    totals = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    alpha, total = temperature(totals, max_repeats, entropy)
    most = float(totals.agg(F.max("tokens")).first()[0] or 0)
    weight = F.pow(F.col("tokens") / most, F.lit(alpha)) / total if most else F.lit(0.0)
    tokens = budget if budget is not None else most * total
    epochs = F.when(F.col("tokens") > 0, weight * tokens / F.col("tokens")).otherwise(1.0)
    named = totals.withColumns({"weight": weight, "epochs": F.round(epochs, 9)}).withColumn("whole", F.floor("epochs"))
    # the partial epoch takes the first blocks of its permutation, as many as its budget holds
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("n")).join(
        named.select(F.col("source").alias("__s"), "whole", ((F.col("epochs") - F.col("whole")) * F.col("tokens")).alias("part")),
        F.col("source").eqNullSafe(F.col("__s")),
    )
    sums = sums.withColumn("place", place(F.col("block"), F.col("source"), F.col("whole")))
    run = Window.partitionBy("source").orderBy("place")  # at most BLOCKS rows
    held = (
        sums.withColumn("sum", F.sum("n").over(run)).where("part > 0 and sum <= part")
        .groupBy("source").agg((F.max("place") + 1).alias("places")).withColumnRenamed("source", "__s")
    )
    out = named.join(held, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return materialise(out.withColumn("places", F.coalesce("places", F.lit(0)).cast("long")), "weights")


def source_mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """doc_id, source, tokens, weight, epochs, copies: how often each document is seen; one row per document.

    A null source is a source of its own, a null text has no tokens. Sources without tokens are seen once.
    Rows that repeat are documents of their own; rows that share a doc_id share a block. An empty
    table gives no rows; columns other than doc_id, text and source are not read.
    """
    rows = materialise(token_rows(docs), "tokens")
    names = source_weights(rows, max_repeats, entropy, budget).withColumnsRenamed({"source": "__s", "tokens": "__t"})
    both = rows.join(names, F.col("source").eqNullSafe(F.col("__s")))
    extra = place(F.col("block"), F.col("source"), F.col("whole")) < F.col("places")
    return both.select(
        "doc_id", "source", "tokens", "weight", "epochs", (F.col("whole") + extra.cast("long")).cast("long").alias("copies")
    )


def mixed(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents, with all their columns, each as often as its source's epochs say: repeated rows and null texts too, and a null
    source is a source of its own. An empty table gives no rows."""
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "source", F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(BLOCKS)).alias("block"))
    names = source_weights(materialise(token_rows(docs), "tokens"), **limits).select(F.col("source").alias("__s"), "whole", "places")
    both = rows.join(names, F.col("source").eqNullSafe(F.col("__s")))
    extra = place(F.col("block"), F.col("source"), F.col("whole")) < F.col("places")
    copies = F.expr("if(`__n` > 0, sequence(1L, `__n`), array())")
    return both.withColumn("__n", F.col("whole") + extra.cast("long")).withColumn("__e", F.explode(copies)).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return source_mix(read(spark, sf_dir, "documents"))
