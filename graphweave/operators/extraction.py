"""Checks on what was extracted from chunks: conformance to the schema, and promotion to governed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.functions.text import IDENTIFIER, sanitize


def identifier_guard(name: Column, pattern: str = IDENTIFIER) -> Column:
    """Whether a name may stand as a type or, with PROPERTY_NAME, as a property; null may not."""
    return F.coalesce(name.rlike(pattern.removesuffix("$") + r"\z"), F.lit(False))


def rejected_chunks(nodes: DataFrame, edges: DataFrame, node_types: DataFrame, edge_types: DataFrame) -> DataFrame:
    """chunk_id, kind, type: for each chunk with a type that the schema lacks, the first by kind (nodes first) and type.
    One offender rejects the whole chunk. The types of edges' ends are not checked."""
    bad = nodes.join(node_types.select(F.col("type").alias("node_type")), "node_type", "left_anti").select("chunk_id", F.lit(0).alias("k"), F.col("node_type").alias("type"))
    bad = bad.unionByName(edges.join(edge_types.select(F.col("type").alias("rel_type")), "rel_type", "left_anti").select("chunk_id", F.lit(1).alias("k"), F.col("rel_type").alias("type")))
    first = bad.groupBy("chunk_id").agg(F.min(F.struct("k", F.coalesce("type", F.lit("")).alias("type"))).alias("x"))
    return first.select("chunk_id", F.when(F.col("x.k") == 0, "node").otherwise("edge").alias("kind"), "x.type")


def conforming(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    return rows.join(rejected.select("chunk_id").distinct(), "chunk_id", "left_anti")


def promote(nodes: DataFrame, run: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Extracted nodes (chunk_id, node_type, primary_value) of chunks without a fault, cleaned and stamped with their key,
    and the chunks that are rejected: a type or value that is blank after cleaning rejects its whole chunk."""
    clean = nodes.withColumns({c: sanitize(F.coalesce(c, F.lit(""))) for c in ("node_type", "primary_value")})
    bad = clean.where("node_type = '' or primary_value = ''").select("chunk_id").distinct()
    good = conforming(clean, bad).withColumns({"run_id": F.lit(run), "schema_version": F.lit(version)})
    return good.withColumn("dedupe_key", F.concat_ws("|", "node_type", "primary_value", "schema_version")), bad


def model_errors(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with errors: the names of the rules that they break, in order. A rule that gives null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())]))
    return rows.withColumn("errors", broken)


def not_blank(c: Column) -> Column:
    return sanitize(c) != ""


def is_hash(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")
