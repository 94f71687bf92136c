"""Proposals as a state machine over many events: folded in order, in parallel, and in any split into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.governance import TRANSITIONS
from graphweave.plans.tables import carried, materialise, ranged

STATES = sorted({s for move in TRANSITIONS for s in move})
ALLOWED = frozenset(TRANSITIONS)
PARTS = "proposal_id long, part int, last_seq long, ends array<int>"
STEPS = "proposal_id long, seq long, state string, wanted string, outcome string"


def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to one row per proposal and part: for each state to enter with, the number of the one to leave with."""
    place = {s: i for i, s in enumerate(STATES)}
    key, last, ends = None, None, None
    for batch in batches:
        out = []
        for part, proposal, seq, wanted in zip(*(batch.column(c).to_pylist() for c in ("__range", "proposal_id", "seq", "wanted")), strict=True):
            if (proposal, part) != key:
                out += [(*key, last, ends)] if key else []
                key, ends = (proposal, part), list(range(len(STATES)))
            last = seq
            ends = [place[wanted] if (STATES[i], wanted) in ALLOWED else i for i in ends]
        yield parts_batch(out)
    if key:
        yield parts_batch([(*key, last, ends)])


def parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["proposal_id", "part", "last_seq", "ends"])


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events, of which the first of each proposal and part has the state to enter with, to what each did."""
    key, state = None, None
    for batch in batches:
        out = []
        for part, proposal, seq, wanted, entry in zip(*(batch.column(c).to_pylist() for c in ("__range", "proposal_id", "seq", "wanted", "entry")), strict=True):
            if (proposal, part) != key:
                key, state = (proposal, part), entry
            ok = (state, wanted) in ALLOWED
            out.append((proposal, seq, state, wanted, "unknown" if state is None else "moved" if ok else "illegal"))
            state = wanted if ok else state
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["proposal_id", "seq", "state", "wanted", "outcome"])


def fold(events: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """proposals (proposal_id, state, last_seq: null before the first event) after events (proposal_id, seq, wanted), and
    proposal_id, seq, state, wanted, outcome of each event: moved, illegal (the move is not allowed: the state stays),
    late (not after last_seq: passed over) or unknown (no such proposal).

    Events of a proposal are taken in the order of seq and wanted. What a run of events does is a map from states to states,
    and maps are composed: so a proposal with any number of events is cut into parts, whose maps are made in
    parallel, joined in order, and give each part the state to begin with.
    """
    known = events.join(proposals.select("proposal_id", "state", F.col("last_seq").alias("before")), "proposal_id", "left")
    late = F.coalesce(F.col("seq") <= F.col("before"), F.lit(False))
    known = materialise(known.withColumn("late", late), "events")
    cut = ranged(known.where("not late").select("proposal_id", "seq", "wanted"), "proposal_id", "seq", "wanted")
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__range", "proposal_id", "seq", "wanted"]
    deal = lambda df: df.repartition(n, "__range").sortWithinPartitions(*order)
    parts = materialise(deal(cut).select(*order).mapInArrow(composed, PARTS), "parts")
    names = F.array(*map(F.lit, STATES))
    index = F.array_position(names, F.col("state")).cast("int") - 1
    # of a proposal as many rows as it has parts
    listed = parts.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("parts"), F.max("last_seq").alias("seen"))
    both = listed.join(proposals, "proposal_id", "left").withColumn("at", index)
    step = lambda acc, p: F.struct(F.get(p.ends, acc.at).alias("at"), F.array_append(acc.entries, acc.at).alias("entries"))
    start = F.struct(F.col("at"), F.array().cast("array<int>").alias("entries"))
    both = materialise(both.withColumn("run", F.aggregate("parts", start, step)), "runs")
    entries = both.select("proposal_id", F.explode(F.arrays_zip(F.col("parts.part").alias("part"), F.col("run.entries").alias("entry"))).alias("e")).select(
        "proposal_id", F.col("e.part").alias("__range"), F.get(names, F.col("e.entry")).alias("entry"))
    each = deal(cut.join(entries, ["proposal_id", "__range"], "left")).select(*order, "entry").mapInArrow(walked, STEPS)
    passed = known.where("late").select("proposal_id", "seq", "state", "wanted", F.lit("late").alias("outcome"))
    new = both.select("proposal_id", F.get(names, F.col("run.at")).alias("__state"), F.col("seen").alias("__seen"))
    after = proposals.join(new, "proposal_id", "left").select("proposal_id", F.coalesce("__state", "state").alias("state"), F.coalesce("__seen", "last_seq").alias("last_seq"))
    return after, each.unionByName(passed)


def guarded(calls: DataFrame, executions: DataFrame, locks: DataFrame, seconds: int) -> DataFrame:
    """call_id, outcome, retry_after of calls (call_id, run_id, at): execution_cooldown while an execution (run_id, at) of the run is less
    than so many seconds ago, with the whole seconds left and one more; schema_not_locked without a lock (run_id); else ok."""
    none, at = F.lit(None), F.col("at").cast("timestamp").alias("at")
    rows = calls.select("run_id", at, F.lit(1).alias("kind"), F.col("call_id").cast("string").alias("call_id"), none.cast("timestamp").alias("ran"))
    rows = rows.unionByName(executions.select("run_id", at, F.lit(0).alias("kind"), F.lit("").alias("call_id"), F.col("at").cast("timestamp").alias("ran")))
    last = carried(rows, ["run_id"], ["at", "kind", "call_id"], "ran").where("kind = 1")
    left = F.lit(float(seconds)) - (F.unix_micros("at") - F.unix_micros("last")) / 1e6
    held = locks.select("run_id").distinct().withColumn("held", F.lit(True))
    both = last.join(held, "run_id", "left").withColumn("left", F.when(left > 0, left))
    outcome = F.when(F.col("left").isNotNull(), "execution_cooldown").when(F.col("held").isNull(), "schema_not_locked").otherwise("ok")
    return both.select(F.col("call_id").cast(dict(calls.dtypes)["call_id"]).alias("call_id"), outcome.alias("outcome"), (F.floor("left") + 1).alias("retry_after"))
