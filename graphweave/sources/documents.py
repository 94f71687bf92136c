"""Documents as sources: binary files, their type, their text, manifests and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.text import nul_hash, strip
from graphweave.sources.hashing import hashes, literal

# File extensions that are read as text. .pdf and .docx are types of their own; any other is unknown.
TEXT_EXTENSIONS = [".txt", ".md", ".rst", ".csv", ".tsv", ".html", ".htm", ".xml", ".json", ".log"]

#: Bytes of a file up to which one task reads it whole.
WHOLE = 128 << 20


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, size, content of the files under path. Empty files are rejected: Spark's reader gives no row for them. A file is one row
    of at most 2 GB; `file_hashes` bears more."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, size, content_hash of the files under path; as in `binary_files`, empty ones have no row. Files over WHOLE bytes are hashed
    in parts. Those with the extension of a compression codec, or a first _, can't be read in parts: they are read whole."""
    name, hashed = F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("content_hash")
    reader = lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader().load(path)
    large = [(r.path, r.length, r.name) for r in files.where(F.col("length") > WHOLE).select("path", "length", name).collect()]
    jvm = spark._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    whole = [p for p, _, n in large if n.startswith("_") or codecs.getCodec(jvm.org.apache.hadoop.fs.Path(p)) is not None]
    rows = files.where(F.col("length") <= WHOLE)  # the reader opens no others
    if whole:
        rows = rows.unionByName(reader().load([literal(p) for p in whole]))
    out = rows.select(name, F.col("length").alias("size"), hashed)
    cut = [x for x in large if x[0] not in whole]
    if not cut:
        return out
    found = hashes(spark.sparkContext, [(p, size) for p, size, _ in cut])
    return out.unionByName(spark.createDataFrame([(n, size, h) for (_, size, n), h in zip(cut, found, strict=True)], out.schema))


def extension(name: Column) -> Column:
    """The lower-cased last extension of a file name with its dot; a leading or a last dot begins none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def file_type(name: Column, content: Column) -> Column:
    """pdf, docx, text or unknown: by the extension, and without one by the first bytes."""
    suffix, head = extension(name), F.hex(F.substring(content, 1, 4))
    return (
        F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").when(suffix.isin(TEXT_EXTENSIONS), "text").when(suffix != "", "unknown")
        .when(head == "25504446", "pdf").when(head == "504B0304", "docx").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("unknown")
    )


def raw_text(files: DataFrame) -> DataFrame:
    """doc_id, text, error of files (doc_id, name, content) by the text tier: UTF-8, else Latin-1. Files of another type
    (unsupported_type: they need a parser of their own) and blank ones (empty_text) are errors."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    typed = files.withColumns({"__type": file_type(F.col("name"), F.col("content")), "__text": text})
    error = F.when(F.col("__type") != "text", "unsupported_type").when(strip(F.coalesce("__text", F.lit(""))) == "", "empty_text")
    return typed.select("doc_id", F.when(error.isNull(), F.col("__text")).alias("text"), error.alias("error"))


def locator(page: Column, index: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit(":c"), index.cast("string"))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id and locator beside the columns of chunks (doc_id, start_page, chunk_index)."""
    return chunks.withColumns({"chunk_id": nul_hash(F.col("doc_id"), F.col("start_page"), F.col("chunk_index")), "locator": locator(F.col("start_page"), F.col("chunk_index"))})


def manifests(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document: run_id, doc_id, source, content_hash, its chunk ids in order, and their number."""
    ids = chunks.groupBy("run_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id")))["chunk_id"].alias("chunk_ids"))
    content = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return ids.join(content, "doc_id").withColumn("n_chunks", F.size("chunk_ids"))


def list_manifests(rows: DataFrame, run: str) -> DataFrame:
    """The manifests of a run, the newest first."""
    return rows.where(F.col("run_id") == run).orderBy(F.desc("created_at"), "doc_id")


def chunks_of(chunks: DataFrame, run: str, docs: DataFrame) -> DataFrame:
    """Chunk metadata and text length of some documents (doc_id) of a run, in the order of the locators as text."""
    mine = chunks.where(F.col("run_id") == run).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return mine.select("doc_id", "chunk_id", "locator", F.char_length("text").alias("text_length")).orderBy("doc_id", "locator")


def chunk_text(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requests (chunk_id) with text and outcome: found, CHUNK_NOT_FOUND, or INVALID_CHUNK_ID for what is no hash."""
    valid = F.coalesce(F.col("chunk_id").rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
    got = requests.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    outcome = F.when(~valid, "INVALID_CHUNK_ID").when(F.col("text").isNull(), "CHUNK_NOT_FOUND").otherwise("found")
    return got.select("chunk_id", "text", outcome.alias("outcome"))


def collection_stats(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether each run has chunks, and how many."""
    count = chunks.groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.join(count, "run_id", "left").select("run_id", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("points"))


def store(df: DataFrame, path: str) -> None:
    """Append rows as files per run."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def delete_documents(requests: DataFrame, held: DataFrame, chunks: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Outcome of each request (doc_id): deleted or not_found; and the manifests, chunks and jobs that are left. The graph
    keeps what was read from the documents."""
    keys = requests.select("doc_id").distinct()
    have = held.select("doc_id").distinct().withColumn("held", F.lit(True))
    outcome = keys.join(have, "doc_id", "left").select("doc_id", F.when(F.col("held"), "deleted").otherwise("not_found").alias("outcome"))
    gone = keys.join(have, "doc_id").select("doc_id")
    return outcome, *(df.join(gone, "doc_id", "left_anti") for df in (held, chunks, jobs))


def pending_chunks(held: DataFrame, jobs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, chunk_id, status, batch: the chunks of manifests that have no complete job, in batches of `size` per
    document in the manifest's order."""
    each = held.select("doc_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    left = each.join(jobs.select("chunk_id", "status"), "chunk_id", "left").where(F.coalesce("status", F.lit("")) != "complete")
    # a document's pending chunks in order: their places count from 0
    order = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "status"))).alias("all"))
    one = order.select("doc_id", F.posexplode("all").alias("nth", "x"))
    return one.select("doc_id", "x.chunk_id", F.coalesce("x.status", F.lit("new")).alias("status"), F.floor(F.col("nth") / size).alias("batch"))
