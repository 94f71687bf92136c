"""Document, evidence and job operators: identities, elements, top-k by cosine, latest status, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions.text import nul_hash, strip


def identities(docs: DataFrame, run: str = "run1") -> DataFrame:
    """content_hash and doc_hash of each document."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select("doc_id", content.alias("content_hash"), nul_hash(F.lit(run), F.coalesce("source", F.lit("")), content).alias("doc_hash"))


# How blocks of each kind begin, or for tables what one of their lines is.
HEADING, TABLE, LIST_ITEM = r"(?U)^#{1,6}\s+\S", r"(?Um)^\|?[\s\-:]+(\|[\s\-:]+)+\|?\s*$", r"(?U)^([-*+]\s+|\d+[.)]\s+)"


def classify(block: Column) -> Column:
    """heading, table, list_item or paragraph: by the first line, but a table by a separator line anywhere; so only what has a
    bar is searched for one."""
    first = strip(F.substring_index(block, "\n", 1))
    return (
        F.when(first.rlike(HEADING), "heading").when(F.contains(block, F.lit("|")) & block.rlike(TABLE), "table").when(first.rlike(LIST_ITEM), "list_item").otherwise("paragraph")
    )


def elements(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """doc_id, pos, element_type, text, page: the blocks of each document between blank lines, stripped, blank ones left
    out, on page 0. separator is for sources whose paragraphs are parted otherwise, such as by single line ends."""
    blocks = docs.select("doc_id", F.posexplode(F.split("text", separator, -1)).alias("pos", "block")).withColumn("text", strip(F.col("block"))).where("text <> ''")
    return blocks.select("doc_id", F.col("pos").cast("long").alias("pos"), classify(F.col("text")).alias("element_type"), "text", F.lit(0).alias("page"))


# The flags that a chunk may have.
FLAGS = ["low_ocr_confidence", "low_text_density", "raw_fallback"]


def quality_summary(chunks: DataFrame) -> DataFrame:
    """Per document: chunks with each flag (array flags), chunks with any, and all."""
    each = [F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS]
    return chunks.groupBy("doc_id").agg(*each, F.count_if(F.size("flags") > 0).alias("flagged_chunks"), F.count("*").alias("total_chunks"))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10, run: str | None = None) -> DataFrame:
    """The k nearest by cosine to one query vector, of one run if named; k is at most 50."""
    vectors = vectors if run is None else vectors.where(F.col("run_id") == run)
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding")
    score = dot(v, q) / F.sqrt(dot(v, v.cast("array<double>")) * dot(q, q))
    return vectors.select("vec_id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(min(k, 50))


def latest_status(events: DataFrame) -> DataFrame:
    """Of each user and type the latest event."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


def telemetry(records: DataFrame) -> DataFrame:
    """Per agent: tokens in and out, cost and count, of the last record of each run, candidate and agent (by ts and seq)."""
    last = records.groupBy("run_id", "candidate_id", "agent").agg(F.max_by(F.struct("tokens_in", "tokens_out", "cost"), F.struct("ts", "seq")).alias("x"))
    sums = [F.sum("x.tokens_in").alias("tokens_in"), F.sum("x.tokens_out").alias("tokens_out"), F.round(F.sum("x.cost"), 4).alias("cost")]
    return last.groupBy("agent").agg(*sums, F.count("*").alias("invocations")).orderBy("agent")


def telemetry_of_run(records: DataFrame, run: str) -> DataFrame:
    """The last record of each candidate and agent of a run."""
    last = records.where(F.col("run_id") == run).groupBy("candidate_id", "agent").agg(F.max_by(F.struct("tokens_in", "tokens_out", "cost"), F.struct("ts", "seq")).alias("x"))
    return last.select("candidate_id", "agent", "x.*").orderBy("candidate_id", "agent")


def histogram(samples: DataFrame, names: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """Per name (columns name, value, ts, seq): count, sum, least, most, mean and percentiles at the floor index of the
    sorted values, over the last `most` samples; nulls don't count. A name in names without samples has zeros.

    The buffer of `most` samples is the feature: a window ranks from the newest and drops the rest early, and what
    is left of a name is bounded.
    """
    newest = Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("seq"))
    kept = samples.where("value is not null").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= most)
    got = kept.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("v"), F.sum("value").alias("sum"))
    if names is not None:
        got = names.select("name").distinct().join(got, "name", "left")
    n = F.coalesce(F.size("v"), F.lit(0))
    n = F.when(F.col("v").isNull(), 0).otherwise(n)
    at = lambda i: F.coalesce(F.get("v", i), F.lit(0.0))
    percentile = lambda q: at(F.greatest(F.floor(n * F.lit(q)) - 1, F.lit(0)).cast("int"))
    total = F.round(F.coalesce("sum", F.lit(0.0)), 4)
    mean = F.round(F.when(n > 0, F.col("sum") / n).otherwise(0.0), 6)
    return got.select("name", n.cast("long").alias("n"), total.alias("total"), at(F.lit(0)).alias("least"), at(n - 1).alias("most"), mean.alias("mean"),
                      percentile(0.5).alias("p50"), percentile(0.95).alias("p95"), percentile(0.99).alias("p99"))
