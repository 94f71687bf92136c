"""Job status as a stream: events arrive as files, and the latest status of each job is kept in a table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.plans.tables import shared_dir


def snapshot(spark: SparkSession, where: str) -> tuple[int, str | None]:
    """The last merged batch under a stream's folder and its table; -1 and None before the first."""
    try:
        row = spark.read.parquet(f"{where}/pointer").orderBy(F.desc("batch")).first()
    except AnalysisException:
        row = None
    return (row["batch"], row["path"]) if row else (-1, None)


def latest_status_stream(spark: SparkSession, path: str, name: str, where: str | None = None) -> DataFrame:
    """user_id, event_type, event_id, n of all event files under path, in as many micro-batches as there are.

    Each batch is merged into a snapshot in the folder `where` (a new one by default), beside the stream's checkpoint, and
    a pointer is written after the snapshot: a stream that starts again there goes on where it stopped, and a
    batch that is merged already is skipped when it comes again.
    """
    schema = spark.read.parquet(f"{path}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(path)
    where = where or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], "user_id long, event_type string, ts timestamp, event_id long, n long")

    def held(table: str | None) -> DataFrame:
        return empty if table is None else spark.read.schema(empty.schema).parquet(table)

    def merge(batch: DataFrame, number: int) -> None:
        last, table = snapshot(spark, where)
        if number <= last:
            return
        new = batch.select("user_id", "event_type", "ts", "event_id", F.lit(1).cast("long").alias("n"))
        both = held(table).unionByName(new).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("last"), F.sum("n").alias("n"))
        now = f"{where}/table-{number}"
        both.select("user_id", "event_type", "last.ts", "last.event_id", "n").write.mode("overwrite").parquet(now)
        spark.createDataFrame([(number, now)], "batch long, path string").coalesce(1).write.mode("append").parquet(f"{where}/pointer")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return held(snapshot(spark, where)[1]).select("user_id", "event_type", "event_id", "n")
