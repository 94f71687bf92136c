"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the setting is unset, a local master gets a temporary folder and a
    cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='graphweave-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: The lists of the scopes that are open in this thread of control, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("_open", default=())


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the tables written inside, in this thread alone; whoever opened it may discard them."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    finally:
        _open.reset(token)


def written(df: DataFrame, name: str, **options: object) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it back, with its path: this cuts the lineage, and a
    lost executor costs a reread, not a rerun of what led to the table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for made in _open.get():
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    return written(df, name, **options)[0]


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that nothing reads any more: what was built on them is written."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ranged(df: DataFrame, *by: str, ranges: int | None = None) -> DataFrame:
    """df in the order of `by`, cut into ranges of near equal row counts numbered in that order by the column
    __range; a table, so that all who read it see the same cuts. by should be unique per row, as equal rows
    share a range. ranges is spark.sql.shuffle.partitions by default."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *by).withColumn("__range", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place (from 0) among the rows of its key `by`, in the order of `order`, which should be unique within a
    key. A key of any size is in as many ranges as it fills: places in a range and the counts of the ranges before add up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    # a row's number in its sorted range is taken as the range is written, so that rows are dealt once
    table = materialise(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    table = table.withColumn("__range", F.shiftright("__at", 33))
    counts = table.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", *[F.col(c).alias(f"__{c}") for c in by], (before - F.col("__first")).alias("__shift"))  # a row per key and range
    starts = materialise(starts, "starts")  # few rows for few keys, which Spark then sees
    same = [table["__range"] == starts["__range"], *[table[c].eqNullSafe(starts[f"__{c}"]) for c in by]]
    return table.join(starts, same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


def carried(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "last") -> DataFrame:
    """df with the last value of the column `value` that is not null at or before each row of its key `by` in the order of `order`.
    As in `numbered`, a key of any size is in as many ranges as it fills, and the ranges' last values are handed on."""
    table = ranged(df, *by, *order)
    ends = table.where(F.col(value).isNotNull()).groupBy("__range", *by).agg(F.max_by(value, F.struct(*order)).alias("__v"))
    each = table.select("__range", *by).distinct().select("__range", *[F.col(c).alias(f"__{c}") for c in by])
    each = each.join(ends, [each["__range"] == ends["__range"], *[each[f"__{c}"].eqNullSafe(ends[c]) for c in by]], "left").select(each["__range"], *[f"__{c}" for c in by], "__v")
    before = F.last("__v", ignorenulls=True).over(Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select("__range", *[f"__{c}" for c in by], before.alias("__before"))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = table.withColumn("__own", here)
    same = [own["__range"] == starts["__range"], *[own[c].eqNullSafe(starts[f"__{c}"]) for c in by]]
    return own.join(starts, same).select(*df.columns, F.coalesce("__own", "__before").alias(name))


#: Rows of one key from which it counts as heavy, and heavy keys of a join at most.
HEAVY, MOST_HEAVY = 100_000, 1000


def joined(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, which has each key once and in __n how many rows it has. Keys of many rows, a bounded number, are
    broadcast, so that no task gets all rows of one; the others are dealt by key. Both should be tables, as they are read twice."""
    total = facts.agg(F.sum("__n")).first()[0] or 0
    heavy = F.col("__n") >= max(HEAVY, total // MOST_HEAVY)
    if facts.where(heavy).isEmpty():
        return rows.join(facts.drop("__n").hint("merge"), key)
    big = F.broadcast(facts.where(heavy).drop("__n"))
    rest = rows.join(F.broadcast(facts.where(heavy).select(key)), key, "left_anti")
    columns = [*rows.columns, *[c for c in facts.columns if c not in (key, "__n")]]
    return rows.join(big, key).select(*columns).unionByName(rest.join(facts.where(~heavy).drop("__n").hint("merge"), key).select(*columns))


def heavy_keys(keys: DataFrame, key: str) -> DataFrame:
    """The keys of at least HEAVY rows of keys, and of those the MOST_HEAVY with the most rows."""
    counts = keys.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") >= HEAVY) & F.col(key).isNotNull())
    return counts.orderBy(F.desc("__n"), key).limit(MOST_HEAVY).select(key)


def looked_up(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame, spread: list[str]) -> DataFrame:
    """rows with the columns of facts, which has a key (a string) once, or null where it has none. Rows of the heavy keys take theirs from
    a broadcast, and like those without a key they are dealt by the columns in spread, so that no task gets all rows of one."""
    more = [c for c in facts.columns if c != key]
    known = facts.join(F.broadcast(heavy), key).select(key, F.struct(*more).alias("__facts"))
    big = heavy.join(F.broadcast(known), key, "left").select(key, F.struct("__facts").alias("__big"))
    flat = F.col("__big").isNotNull() | F.col(key).isNull()
    dealt = rows.join(F.broadcast(big), key, "left").withColumn("__dealt", F.when(flat, F.concat_ws("\0", key, F.xxhash64(*spread).cast("string"))).otherwise(F.col(key)))
    light = facts.select(F.col(key).alias("__dealt"), F.struct(*more).alias("__light"))
    # a key that happens to be equal to the place of a flat row gives it nothing
    found = lambda c: F.when(F.col("__big").isNotNull(), F.col(f"__big.__facts.{c}")).when(F.col(key).isNotNull(), F.col(f"__light.{c}"))
    return dealt.join(light.hint("merge"), "__dealt", "left").select(*rows.columns, *[found(c).alias(c) for c in more])
