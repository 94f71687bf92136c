"""Rounds of retrieval for candidates whose evidence does not suffice: all that are still open in one plan per round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.plans.tables import materialise

# What an item of evidence adds, what suffices, tokens that a round costs, and chunks that a query brings.
WEIGHTS = [("supporting", 0.3), ("corroborating", 0.15), ("conflicting", 0.1)]
ENOUGH, ROUND_COST, TOP = 0.6, 500, 10
# What the closeness of two names adds, from the highest bound down; and shares of tokens and of neighbours.
CLOSE = [(0.95, 0.5), (0.9, 0.4), (0.85, 0.3)]
NEIGHBOURS, TOKENS, TOKENS_ADD = 0.2, 0.5, 0.05

#: Open candidates (candidate_id, round, items, budget) to candidate_id, query: null where none could be made, blank to stop.
Ask = Callable[[DataFrame], DataFrame]
#: Queries (candidate_id, query) to candidate_id, chunk_id, score.
Search = Callable[[DataFrame], DataFrame]


def baseline(name_score: Column, context: Column, overlap: Column) -> Column:
    """What the structure alone says: names, neighbours and tokens that a pair shares."""
    names = reduce(lambda x, b: x.when(name_score >= b[0], b[1]), CLOSE[1:], F.when(name_score >= CLOSE[0][0], CLOSE[0][1])).otherwise(0.0)
    return F.lit(0.0) + F.coalesce(names, F.lit(0.0)) + F.when(context > 0, F.least(context, F.lit(NEIGHBOURS))).otherwise(0.0) + F.when(overlap >= TOKENS, TOKENS_ADD).otherwise(0.0)


def weight(classification: Column) -> Column:
    return reduce(lambda x, w: x.when(classification == w[0], w[1]), WEIGHTS[1:], F.when(classification == WEIGHTS[0][0], WEIGHTS[0][1])).otherwise(0.0)


def added(score: Column, weights: Column) -> Column:
    """Weights added one by one, as the order of sums decides the last bit."""
    return F.aggregate(weights, score, lambda total, w: total + w)


def retrieve(candidates: DataFrame, items: DataFrame, ask: Ask, search: Search, rounds: int, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Rounds for candidates (candidate_id, baseline, budget, max_rounds) that have items (candidate_id, chunk_id, classification, pos).

    Returns per candidate: candidate_id, rounds_used, budget_left, n_items, score, sufficient, exhausted (nothing new was found), stop;
    and per round: candidate_id, round, query, chunk_ids (new ones in order), budget_left. `rounds` bounds all max_rounds.

    A round asks for a query and costs ROUND_COST. It brings `top` chunks, of which those count that the candidate has not seen, each as
    corroborating evidence. Stops: budget (nothing left), failed (no query), voluntary (a blank one), exhausted (the first round
    brought nothing new), sufficient, and rounds. A null max_rounds or budget is 0. Each round is a table of its own in the shared
    folder; candidates that stopped take no part in later ones.
    """
    own = items.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", weight(F.col("classification")).alias("w")))), lambda x: x.w).alias("w"))
    zero = F.lit(0).cast("long")
    state = candidates.join(own, "candidate_id", "left").select(
        "candidate_id", F.coalesce("budget", zero).cast("long").alias("budget"), F.coalesce("max_rounds", zero).cast("long").alias("max_rounds"),
        F.when(F.col("w").isNull(), F.col("baseline")).otherwise(added(F.col("baseline"), F.col("w"))).alias("score"),
        F.coalesce(F.size("w"), zero).cast("long").alias("items"), zero.alias("new"), zero.alias("used"), F.lit(None).cast("string").alias("stop"))
    state = materialise(state, "state")
    seen, records = [items.select("candidate_id", "chunk_id")], []
    for number in range(1, rounds + 1):
        due = F.col("stop").isNull() & (F.col("max_rounds") >= number)
        open_ = state.where(due & (F.col("budget") > 0))
        asked = ask(open_.select("candidate_id", F.lit(number).alias("round"), "items", "budget")).select("candidate_id", "query")
        asked = materialise(asked, "asked")
        live = asked.where(F.trim("query") != "")
        hits = search(live).groupBy("candidate_id", "chunk_id").agg(F.max("score").alias("score"))
        fresh = hits.join(reduce(DataFrame.unionByName, seen).distinct(), ["candidate_id", "chunk_id"], "left_anti")
        fresh = materialise(fresh.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id"))).alias("found")), "fresh")
        seen.append(fresh.select("candidate_id", F.explode("found.chunk_id").alias("chunk_id")))
        found = F.coalesce(F.size("found"), F.lit(0)).cast("long")
        both = state.join(asked.withColumn("asked", F.lit(True)), "candidate_id", "left").join(fresh, "candidate_id", "left")
        went = F.coalesce(F.trim("query") != "", F.lit(False))
        both = both.withColumns({"went": went, "n": F.when(went, found).otherwise(0).cast("long")})
        left = F.when(F.col("went"), F.greatest(F.col("budget") - ROUND_COST, F.lit(0))).otherwise(F.col("budget"))
        score = F.when(F.col("n") > 0, added(F.col("score"), F.array_repeat(F.lit(dict(WEIGHTS)["corroborating"]), F.col("n").cast("int")))).otherwise(F.col("score"))
        stop = (
            F.when(F.col("stop").isNotNull(), F.col("stop")).when(F.col("max_rounds") < number, F.lit("rounds")).when(F.col("budget") <= 0, "budget")
            .when(F.col("query").isNull(), "failed").when(~F.col("went"), "voluntary").when((F.col("n") == 0) & F.lit(number == 1), "exhausted")
            .when(F.least(F.lit(1.0), score) >= ENOUGH, "sufficient").when(F.col("max_rounds") == number, "rounds")
        )
        ran = F.col("went") | (F.coalesce("asked", F.lit(False)) & F.col("query").isNotNull())
        records.append(both.where(ran).select(
            "candidate_id", F.lit(number).alias("round"), "query", F.coalesce(F.col("found.chunk_id"), F.array().cast(asked_ids(items))).alias("chunk_ids"), left.alias("budget_left")))
        state = materialise(both.select(
            "candidate_id", left.alias("budget"), "max_rounds", score.alias("score"), (F.col("items") + F.col("n")).alias("items"), (F.col("new") + F.col("n")).alias("new"),
            (F.col("used") + ran.cast("long")).alias("used"), stop.alias("stop")), "state")
        if state.where("stop is null").isEmpty():
            break
    final = F.least(F.lit(1.0), F.col("score"))
    ends = state.select(
        "candidate_id", F.col("used").alias("rounds_used"), F.col("budget").alias("budget_left"), F.col("items").alias("n_items"), final.alias("score"), (final >= ENOUGH).alias("sufficient"),
        (F.col("new") == 0).alias("exhausted"), F.coalesce("stop", F.lit("rounds")).alias("stop"))
    return ends, reduce(DataFrame.unionByName, records)


def asked_ids(items: DataFrame) -> str:
    return f"array<{dict(items.dtypes)['chunk_id']}>"
