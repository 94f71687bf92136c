"""Pages, evidence and small aggregates that readers ask for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.operators import graph as G
from graphweave.operators.documents import FLAGS
from graphweave.plans.tables import materialise, numbered


def page(rows: DataFrame, key: list[str], number: int = 1, size: int = 50) -> DataFrame:
    """A page of rows in the order of key, with how many there are in all and whether more follow. The number is 1 at
    least and the size 1 to 5000. Rows are numbered in ranges, so that a deep page holds no more rows than the first."""
    number, size = max(1, number), min(max(1, size), 5000)
    total = rows.agg(F.count("*").alias("total"))
    every = numbered(rows.withColumn("__all", F.lit(1)), ["__all"], key, "__place")
    cut = every.where(F.col("__place").between((number - 1) * size, number * size - 1)).orderBy(*key).drop("__all", "__place")
    return cut.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > number * size)


def page_after(rows: DataFrame, key: list[str], last: tuple | None = None, size: int = 50) -> DataFrame:
    """The first `size` rows behind a key, that of the last row of the page before: what lies before it is passed over by a filter."""
    if last is not None:
        behind = reduce(lambda rest, kv: (F.col(kv[0]) > F.lit(kv[1])) | ((F.col(kv[0]) == F.lit(kv[1])) & rest), list(zip(key, last, strict=True))[::-1], F.lit(False))
        rows = rows.where(behind)
    return rows.orderBy(*key).limit(min(max(1, size), 5000))


def query_value(key: Column) -> Column:
    """What a key is looked up by: its second part between bars, else the whole key."""
    return F.when(F.contains(key, F.lit("|")), F.split_part(key, F.lit("|"), F.lit(2))).otherwise(key)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries and vectors that meet in one task, queries of them at once in memory, and how far a sum's last bits may move a score.
QUERY_BLOCK, VECTOR_BLOCK, AT_ONCE, LAST_BITS = 4096, 16384, 64, 1e-9
#: Classes of vectors whose best are compared first, and pairs that are summed again at once.
CLASSES, PAIRS_AT_ONCE = 512, 32768
#: Tasks of one search at most; more blocks share them.
MOST_TASKS = 4096
HIT = pa.schema([("__q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rounded_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine with its sums in order, rounded half up at the fifth decimal."""
    dot = lambda x, y: reduce(lambda s, xy: s + xy[0] * xy[1], zip(x.tolist(), y.tolist(), strict=True), 0.0)
    score = dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    return float(Decimal(repr(score)).quantize(Decimal("0.00001"), ROUND_HALF_UP))


def directions(x: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their length, in single precision, and which have no direction: these are 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = (x / np.sqrt(long)[:, None]).astype(np.float32)
    none = ~np.isfinite(unit).all(1)
    unit[none] = 0
    return unit, none


def floor_of_best(near: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that k of its numbers reach: of the maxima of CLASSES classes of columns the k-th, else the k-th of all."""
    many = near.shape[1] // CLASSES
    if many >= 4 and k <= CLASSES:
        near = near[:, : many * CLASSES].reshape(len(near), many, CLASSES).max(1)
    at = max(near.shape[1] - k, 0)
    return np.partition(near, at, axis=1)[:, at]


def best_of(ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, vector ids and rounded scores of the k best of the vectors v for each of the queries q, by score and then by id. A vector
    or query without a direction has no score and comes last. Products in single precision find what can be among the best, with room for
    their error; these are summed again in double precision."""
    long = [np.einsum("ij,ij->i", x, x) for x in (q, v)]
    (uq, no_q), (uv, no_v) = (directions(x, n) for x, n in zip((q, v), long, strict=True))
    room = 2e-5 + 2 * (q.shape[1] + 4) * 2.0**-24  # rounding may make those equal
    for at in range(0, len(q), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        near = uq[part] @ uv.T
        near[:, no_v] = -np.inf
        near[no_q[part]] = -np.inf
        row, col = np.nonzero(near >= (floor_of_best(near, k) - room)[:, None])
        score = np.empty(len(row))
        for i in range(0, len(row), PAIRS_AT_ONCE):
            x, y = row[i : i + PAIRS_AT_ONCE] + at, col[i : i + PAIRS_AT_ONCE]
            with np.errstate(divide="ignore", invalid="ignore"):
                score[i : i + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", q[x], v[y]) / np.sqrt(long[0][x] * long[1][y])
        score[~np.isfinite(score)] = -np.inf
        scaled = np.abs(score) * 1e5
        with np.errstate(invalid="ignore"):
            close = np.abs(scaled - np.floor(scaled) - 0.5) < LAST_BITS * 1e5
        score = np.where(np.isfinite(score), np.sign(score) * np.floor(scaled + 0.5) / 1e5 + 0.0, -np.inf)
        for i in np.flatnonzero(close):
            score[i] = rounded_cosine(q[part][row[i]], v[col[i]])
        order = np.lexsort((vec_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        yield ids[part][row[kept]], vec_ids[col[kept]], score[kept]


def matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """Rows of numbers; one that is null or of another length has none."""
    flat = pc.list_flatten(column)
    if not column.null_count and not flat.null_count and pc.all(pc.equal(pc.list_value_length(column), wide)).as_py():
        return flat.to_numpy().astype(np.float64).reshape(len(column), wide)
    rows = [x if x is not None and len(x) == wide else [None] * wide for x in column.to_pylist()]
    return np.array(rows, np.float64).reshape(len(rows), wide)


def meet(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The k best of a block of vectors for each of a block of queries."""
        found = []
        lengths = pc.fill_null(pc.list_value_length(queries["q"]), 0)
        for wide in pc.unique(lengths).to_pylist() if vectors.num_rows else []:
            mine = queries.filter(pc.equal(lengths, wide))
            found += best_of(mine["__q"].to_numpy(), matrix(mine["q"], wide), vectors["vec_id"].to_numpy(), matrix(vectors["embedding"], wide), k)
        ids, hits, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64(), mask=np.isneginf(scores))], schema=HIT)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, vec_id, score: the k nearest vectors (vec_id long, embedding) by cosine to each query (query, q); k is at most 50.

    Equal query vectors are searched for once. All pairs are compared, a block of queries with a block of vectors in each task, as one
    product of matrices; a task returns its k best per query. A score is that of the sums in order: where the product's last bits could
    change its fifth decimal, it is summed again. A vector without a direction, or of another length, has no score and comes last.
    """
    k = min(k, 50)
    wanted = materialise(queries.select("q").distinct().withColumn("__q", F.monotonically_increasing_id()), "wanted")
    mine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    blocks = [max(1, -(-df.count() // size)) for df, size in ((wanted, QUERY_BLOCK), (mine, VECTOR_BLOCK))]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("__a", F.pmod(F.xxhash64("__q"), F.lit(blocks[0]))).withColumn("__b", each(blocks[1]))
    right = mine.withColumn("__b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks[1]))).withColumn("__a", each(blocks[0]))
    # few bytes but much work: a number that is given keeps blocks from being put together in one task
    tasks = min(2 * blocks[0] * blocks[1], MOST_TASKS)
    left, right = (df.withColumns({c: F.col(c).cast("long") for c in ("__a", "__b")}).repartition(tasks, "__a", "__b").groupBy("__a", "__b") for df in (left, right))
    found = left.cogroup(right).applyInArrow(meet(k), "__q long, vec_id long, score double")
    first = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k).drop("r")
    asked = queries.select("query", F.col("q").alias("__v"))
    asked = asked.join(wanted, F.col("__v").eqNullSafe(F.col("q"))).select("query", "__q")
    return first(asked.join(first(found, "__q"), "__q").select("query", "vec_id", "score"), "query")


def best_scores(found: DataFrame) -> DataFrame:
    """vec_id, score: of a chunk found by several queries the best score, the best first."""
    return found.groupBy("vec_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "vec_id")


def first_per_chunk(found: DataFrame) -> DataFrame:
    """query, vec_id, score: each chunk under the first query (column pos) that found it."""
    return found.groupBy("vec_id").agg(F.min_by(F.struct("query", "score"), "pos").alias("x")).select("x.query", "vec_id", "x.score")


def page_of_document(chunks: DataFrame, doc: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """Chunks of a document in the order of their ids, with a score of 0; at most 200."""
    return chunks.where(doc).select("chunk_id", F.lit(0.0).alias("score")).orderBy("chunk_id").offset(offset).limit(min(limit, 200))


def complete(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows that have all required fields."""
    return rows.dropna(subset=required)


def type_counts(found: DataFrame) -> DataFrame:
    """How many findings each type has, in the types' order; types without any are left out."""
    return found.groupBy("candidate_type").agg(F.count("*").alias("n")).orderBy(G.rank_in(F.col("candidate_type"), G.TYPES))


def flag_summary(chunks: DataFrame) -> DataFrame:
    """Chunks with each flag, over all documents given."""
    return chunks.agg(*[F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS])


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs of each run: all, complete, failed, and the rest as pending."""
    rest = ~F.coalesce(F.col("status").isin("complete", "failed"), F.lit(False))
    each = [F.count_if(F.col("status") == s).alias(s) for s in ("complete", "failed")]
    return jobs.groupBy("run_id").agg(F.count("*").alias("total"), *each, F.count_if(rest).alias("pending"))


def entity_yield(jobs: DataFrame) -> DataFrame:
    """Created and matched entities over complete jobs."""
    done = F.when(F.col("status") == "complete", F.coalesce("created", F.lit(0)) + F.coalesce("matched", F.lit(0))).otherwise(0)
    return jobs.agg(F.sum(done).cast("long").alias("entities"))


def rollups(proposals: DataFrame) -> DataFrame:
    """dimension, value, n: proposals by state and by class in one pass."""
    each = proposals.groupingSets([["state"], ["proposal_class"]], "state", "proposal_class").agg(F.count("*").alias("n"), F.grouping("state").alias("g"))
    return each.select(F.when(F.col("g") == 0, "state").otherwise("class").alias("dimension"), F.when(F.col("g") == 0, F.col("state")).otherwise(F.col("proposal_class")).alias("value"), "n")


def by_parser(manifests: DataFrame) -> DataFrame:
    """Documents and chunks by parser; a blank one is unknown."""
    name = F.when(F.trim(F.coalesce("parser", F.lit(""))) == "", "unknown").otherwise(F.col("parser"))
    return manifests.groupBy(name.alias("parser")).agg(F.count("*").alias("documents"), F.sum("n_chunks").cast("long").alias("chunks"))


def central(degrees: DataFrame, most: int = 10) -> DataFrame:
    """The `most` nodes of highest degree with the size of their bubble: 50 for the highest, 8 at least."""
    top = degrees.orderBy(F.desc("total"), "dedupe_key").limit(most)
    share = F.floor(F.lit(50) * F.col("total") / F.greatest(F.max("total").over(Window.partitionBy()), F.lit(1)))
    return top.withColumn("bubble", F.greatest(share, F.lit(8)))


def degrees_with_types(degrees: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees with the node's type; a key without a node has none."""
    kinds = nodes.groupBy("dedupe_key").agg(F.max_by("node_type", "seq").alias("node_type"))
    return degrees.join(kinds, "dedupe_key", "left")


def schema_rules(types: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, subject: node:T of each type, and edge:T of each edge with its ends."""
    node = types.select(F.concat(F.lit("node:"), "type").alias("rule"), F.col("primary_property").alias("subject"))
    edge = edges.select(F.concat(F.lit("edge:"), "rel_type").alias("rule"), F.concat_ws(" > ", "start_type", "end_type").alias("subject"))
    return node.unionByName(edge)


def context_of(refs: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """candidate_id, ref, n, first: of each candidate's references how many neighbours they have, and the least of them; and ref, neighbor:
    all neighbours of these references. A hub's neighbours are rows of its own, once, and not once per candidate that names it."""
    each = refs.select("candidate_id", F.explode("refs").alias("ref")).distinct()
    near = G.neighbors(rels).withColumnRenamed("dedupe_key", "ref").join(each.select("ref").distinct(), "ref", "left_semi")
    count = near.groupBy("ref").agg(F.count("*").alias("n"), F.min("neighbor").alias("first"))
    return each.join(count, "ref", "left").select("candidate_id", "ref", F.coalesce("n", F.lit(0)).cast("int").alias("n"), "first"), near
