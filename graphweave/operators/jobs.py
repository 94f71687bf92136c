"""Job tables, logs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Log levels in rising order.
LEVELS = ["debug", "info", "warning", "error", "critical"]


def level_rank(level):  # noqa: ANN001, ANN201
    """Place of a level in rising order from 0; an unknown level counts as the lowest."""
    return F.greatest(F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1, F.lit(0))


def logs(events: DataFrame, least: str = "info", most: int = 1000) -> DataFrame:
    """The newest `most` log rows of at least a level."""
    return events.where(level_rank(F.col("level")) >= LEVELS.index(least)).orderBy(F.desc("ts"), F.desc("event_id")).limit(min(most, 1000))


def activity(events: DataFrame, names: list[str], most: int = 100, run: str | None = None) -> DataFrame:
    """The newest rows that are warnings or worse, or whose name is listed; with a run, those of the run or of none."""
    rows = events if run is None else events.where((F.col("run_id") == run) | F.col("run_id").isNull())
    return rows.where((level_rank(F.col("level")) >= LEVELS.index("warning")) | F.col("event_type").isin(names)).orderBy(F.desc("ts"), F.desc("event_id")).limit(min(most, 100))


def status_counts(jobs: DataFrame, by: str) -> DataFrame:
    """Jobs by status per `by`; what is neither complete, failed nor cancelled is pending."""
    done = F.col("status").isin("complete", "failed", "cancelled")
    return jobs.groupBy(by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "failed", "cancelled")],
        F.count_if(F.coalesce(~done, F.lit(True))).alias("pending"))


def cancel(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs become cancelled."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "cancelled").otherwise(F.col("status")))


def counters(samples: DataFrame) -> DataFrame:
    """Sum and last value of each metric and label."""
    return samples.groupBy("name", "label").agg(F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


def stale(manifests: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming document: reuse where content and parser settings are unchanged, else why not."""
    old = manifests.select("doc_id", F.col("content_hash").alias("__c"), F.col("parser_hash").alias("__p"))
    why = F.when(F.col("__c").isNull(), "new").when(F.col("__c") != F.col("content_hash"), "content_changed").when(F.col("__p") != F.col("parser_hash"), "parser_changed").otherwise("reuse")
    return incoming.join(old, "doc_id", "left").select("doc_id", why.alias("outcome"))
