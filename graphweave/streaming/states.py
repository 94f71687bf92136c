"""State that micro-batches carry on: proposals that events move, and keys that expire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators.machine import fold
from graphweave.plans.snapshots import Snapshots, Tables

#: The tables so far and a batch to the tables after it, and rows that are added to logs.
Merge = Callable[[Tables, DataFrame], tuple[Tables, Tables]]


def carried_on(spark: SparkSession, path: str, name: str, where: str, merge: Merge, files: int | None = None) -> Snapshots:
    """Merge all files under path that are new since the last call into the tables under `where`, one version per micro-batch of so many
    files. The version's number is the batch's, so a batch that comes again after a restart is merged once."""
    schema = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true")
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    held = Snapshots(spark, where)

    def one(batch: DataFrame, number: int) -> None:
        base = held.version()
        if base.number >= number:
            return
        new, more = merge(held.read(base) if base.number >= 0 else {}, batch)
        out = held.commit(base, new, more=more)
        if out.state != "committed" or out.version.number != number:
            raise RuntimeError(f"batch {number} met version {out.version.number}: another stream writes here")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return held


def proposal_stream(spark: SparkSession, path: str, name: str, where: str, proposals: DataFrame, moves: Callable[[DataFrame], DataFrame], files: int | None = None) -> Tables:
    """Tables states (proposal_id, state, last_seq) and steps (what each event did) after all events under path; moves makes
    proposal_id, seq, wanted of them. Events that come behind later ones of their proposal are passed over, and steps says so."""

    def merge(held: Tables, batch: DataFrame) -> tuple[Tables, Tables]:
        after, steps = fold(moves(batch), held.get("states", proposals))
        return {"states": after}, {"steps": steps}

    return carried_on(spark, path, name, where, merge, files).read()


def expiring_stream(spark: SparkSession, path: str, name: str, where: str, entries: Callable[[DataFrame], DataFrame], files: int | None = None) -> Tables:
    """Table keys (key, value, set_at, expires_at) of what has not expired, and clock (now): the latest time that any entry was set.

    entries makes key, value, set_at, ttl_s of the events. The entry set last counts, whatever batch it comes in; a key whose time is over
    by the clock leaves the state, and an entry that comes when it is over already never enters."""
    last = lambda c: F.max_by(c, F.struct("set_at", "value"))

    def merge(held: Tables, batch: DataFrame) -> tuple[Tables, Tables]:
        fields = ["key", "value", "set_at", "expires_at"]
        at = F.col("set_at").cast("timestamp")
        new = entries(batch).select("key", "value", at.alias("set_at"), (at + F.make_dt_interval(secs=F.col("ttl_s"))).alias("expires_at"))
        clock = new.agg(F.max("set_at").alias("now"))
        if held:
            new, clock = new.unionByName(held["keys"].select(*fields)), clock.unionByName(held["clock"]).agg(F.max("now").alias("now"))
        each = new.groupBy("key").agg(last("value").alias("value"), F.max("set_at").alias("set_at"), last("expires_at").alias("expires_at"))
        alive = each.crossJoin(F.broadcast(clock)).where(F.col("expires_at") > F.col("now")).select(*fields)
        return {"keys": alive, "clock": clock}, {}

    return carried_on(spark, path, name, where, merge, files).read()


def looked_up(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (key, at) with value, seconds_left and outcome: found, expired (its time is over at that moment) or unknown."""
    both = requests.join(keys.select("key", "value", "expires_at"), "key", "left")
    left = (F.unix_micros("expires_at") - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    outcome = F.when(F.col("expires_at").isNull(), "unknown").when(left <= 0, "expired").otherwise("found")
    return both.select("key", "at", F.when(outcome == "found", F.col("value")).alias("value"), F.when(outcome == "found", F.ceil(left)).alias("seconds_left"), outcome.alias("outcome"))
