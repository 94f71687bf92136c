"""Chunks into a vector index: batches that fail alone, and points that replace those of the same chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.plans.snapshots import Outcome, Snapshots
from graphweave.plans.tables import materialise, numbered

#: Texts to as many vectors; it may raise.
Embed = Callable[[list[str]], list[list[float]]]
#: Chunks that are embedded at once.
BATCH = 100
POINTS = "run_id string, chunk_id string, doc_id long, locator string, text string, vector array<float>"
ERRORS = "run_id string, batch long, stage string, first long, last long, error string"


def embedding(embed: Embed, dims: int):  # noqa: ANN201
    """Rows in the order of run, batch and place to points, or to one row of error per batch that failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            base = {"run_id": held[0]["run_id"], "batch": held[0]["batch"], "first": held[0]["place"], "last": held[-1]["place"]}
            empty, stage = dict.fromkeys(NAMES), "embedding"
            try:
                vectors = embed([r["text"] or "" for r in held])
                if len(vectors) != len(held):
                    raise ValueError(f"{len(vectors)} vectors for {len(held)} texts")
                stage = "upsert"
                if any(len(v) != dims for v in vectors):
                    raise ValueError(f"a vector has not {dims} numbers")
                rows = [empty | {k: r[k] for k in ("run_id", "batch", "place", "chunk_id", "doc_id", "locator", "text")} | {"vector": v} for r, v in zip(held, vectors, strict=True)]
            except Exception as e:  # noqa: BLE001 whatever the caller's function raises is the batch's error
                rows = [empty | base | {"stage": stage, "error": str(e)}]
            return pa.RecordBatch.from_pylist(rows, SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["run_id"], held[0]["batch"]) != (row["run_id"], row["batch"]):
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    return run


SCHEMA = pa.schema([
    ("run_id", pa.string()), ("batch", pa.int64()), ("place", pa.int64()), ("chunk_id", pa.string()), ("doc_id", pa.int64()), ("locator", pa.string()), ("text", pa.string()),
    ("vector", pa.list_(pa.float32())), ("stage", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("error", pa.string()),
])
NAMES = SCHEMA.names
EMBEDDED = (
    "run_id string, batch long, place long, chunk_id string, doc_id long, locator string, text string, vector array<float>, stage string, first long, last long, error string"
)


def embedded(chunks: DataFrame, embed: Embed, dims: int, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Points and errors of chunks (run_id, doc_id, chunk_index, chunk_id, locator, text): a run's chunks in the order of document and
    index are cut into batches of `size`, of which each is embedded whole or not at all.

    Errors say the stage (embedding: embed raised or gave another number of vectors; upsert: a vector has not dims numbers) and the
    first and last place of the batch. A null text is embedded as empty. A run of any size is in as many tasks as it has
    ranges; a batch is in one.
    """
    placed = numbered(chunks.select("run_id", "doc_id", "chunk_index", "chunk_id", "locator", "text"), ["run_id"], ["doc_id", "chunk_index", "chunk_id"])
    placed = placed.withColumn("batch", F.floor(F.col("place") / size))
    dealt = placed.repartition("run_id", "batch").sortWithinPartitions("run_id", "batch", "place")
    rows = dealt.select("run_id", "batch", "place", "doc_id", "chunk_id", "locator", "text").mapInArrow(embedding(embed, dims), EMBEDDED)
    rows = materialise(rows, "embedded")  # embed is called once per chunk
    points = rows.where("error is null").select("run_id", "batch", "place", "chunk_id", "doc_id", "locator", "text", "vector")
    return points, rows.where("error is not null").select("run_id", "batch", "stage", "first", "last", "error")


def last_points(points: DataFrame, fields: list[str]) -> DataFrame:
    """The last point of each chunk_id. Hashes of ids are counted, so that only points whose hash comes again are dealt by their id."""
    points = points.withColumn("__h", F.xxhash64("chunk_id"))
    again = materialise(points.groupBy("__h").agg(F.count("*").alias("n")).where("n > 1").select("__h"), "again")
    rest = [c for c in fields if c != "chunk_id"]
    many = points.join(again, "__h", "left_semi").groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.struct("run_id", "place")).alias("p")).select("chunk_id", "p.*").select(*fields)
    return points.join(again, "__h", "left_anti").select(*fields).unionByName(many)


def index_chunks(index: Snapshots, chunks: DataFrame, embed: Embed, dims: int, size: int = BATCH) -> Outcome:
    """Put chunks into the index's tables points and errors as one version.

    A point takes the place of an older one of its chunk_id; of several in one call the last stays. Points of a batch that failed
    stay as they were. Errors of the runs in the call are replaced, so that calling again with the same chunks changes nothing, and a
    batch that succeeds later leaves no error behind. Points of other runs and chunks stay.
    """
    points, errors = embedded(chunks, embed, dims, size)
    fields = [x.split()[0] for x in POINTS.split(", ")]
    new = last_points(points, fields)
    for _ in range(3):  # another writer may come first
        base = index.version()
        old = index.read(base) if base.number >= 0 else {"points": index.spark.createDataFrame([], POINTS), "errors": index.spark.createDataFrame([], ERRORS)}
        # ids alone say whether any old point stays; where none does, no old text is read
        stay = materialise(old["points"].select("chunk_id").join(new.select("chunk_id"), "chunk_id", "left_anti"), "stay")
        kept = old["points"].where("false") if stay.isEmpty() else old["points"].join(new.select("chunk_id"), "chunk_id", "left_anti")
        kept = kept.select(*fields)
        runs = chunks.select("run_id").distinct()
        out = index.commit(base, {"points": kept.unionByName(new), "errors": old["errors"].join(runs, "run_id", "left_anti").unionByName(errors)})
        if out.state != "conflict":
            break
    return out
