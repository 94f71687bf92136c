"""Rows under keys: laid out in the order of the keys, so that a prefix is a range that skips files; and rows of documents that a
second call replaces."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.plans.tables import materialise


def store(df: DataFrame, path: str, key: str = "key", files: int | None = None) -> None:
    """Write df in ranges of its keys, each a file sorted by key; `files` is spark.sql.shuffle.partitions by default."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def after(prefix: str) -> str | None:
    """The first string behind all that begin with a prefix; None where there is none."""
    chars = list(prefix)
    while chars:
        code = ord(chars[-1]) + 1
        code = 0xE000 if code == 0xD800 else code  # no characters of their own between these
        if code <= 0x10FFFF:
            return "".join([*chars[:-1], chr(code)])
        chars.pop()
    return None


def scan(spark: SparkSession, path: str, prefix: str, key: str = "key") -> DataFrame:
    """The rows whose key begins with a prefix. As a range it is pushed down to the files, whose bounds of the key leave most of them
    unread."""
    rows, end = spark.read.parquet(path), after(prefix)
    return rows.where((F.col(key) >= prefix) & (F.lit(True) if end is None else F.col(key) < end))


def store_documents(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Put rows (run_id, doc_id and others) under their run and a bucket of their document: they replace what is held of the same
    documents, so that storing twice changes nothing; other documents' rows stay. Only the buckets that the documents are in are
    written anew."""
    spark, by = df.sparkSession, ["run_id", "bucket"]
    new = materialise(df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "new")
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        old = old.join(new.select(*by).distinct(), by, "left_semi").join(new.select("run_id", "doc_id").distinct(), ["run_id", "doc_id"], "left_anti")
        new = materialise(new.unionByName(old), "merged")  # not read from where it is written
    new.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
