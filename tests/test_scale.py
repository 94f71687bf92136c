"""Queries whose cost grew faster than their input: hubs, many queries, long tables in one task."""

import numpy as np
from pyspark.sql import functions as F

from graphweave.llm import hilbert_shards as H
from graphweave.operators import chunking as K
from graphweave.operators import curation as C
from graphweave.operators import detect as T
from graphweave.operators import graph as G
from graphweave.operators import execution as X
from graphweave.operators import governance as V
from graphweave.operators import indexing as I
from graphweave.operators import reads as R
from graphweave.operators import write as W
from graphweave.plans import tables as P
from graphweave.plans.tables import materialise


def test_context_of_hub(spark):
    """A hub's neighbours are listed once, however many candidates name it; a loop names its end once."""
    n = 300
    rels = spark.range(n).select(F.concat(F.lit("e"), "id").alias("dedupe_key"), F.format_string("c%04d", "id").alias("start_dedupe_key"), F.lit("hub").alias("end_dedupe_key"))
    refs = rels.select(F.col("dedupe_key").alias("candidate_id"), F.array("start_dedupe_key", "end_dedupe_key").alias("refs"))
    refs = refs.unionByName(spark.createDataFrame([("loop", ["hub", "hub"]), ("alone", ["nobody"])], "candidate_id string, refs array<string>"))
    each, near = R.context_of(refs, rels)
    got = {(r.candidate_id, r.ref): (r.n, r.first) for r in each.collect()}
    assert len(got) == 2 * n + 2 and got["e7", "hub"] == got["loop", "hub"] == (n, "c0000")
    assert got["e7", "c0007"] == (1, "hub") and got["alone", "nobody"] == (0, None)
    assert near.count() == 2 * n and near.where("ref = 'hub'").count() == n


def test_nearest_blocks(spark, monkeypatch):
    """Blocks of any size give what all pairs summed in order give: ties by id, copies, repeated queries, vectors without a direction. Equal
    query vectors meet the vectors once."""
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, (40, 6)).astype(np.float32)
    rows = [(i, base[i % 40].tolist()) for i in range(200)] + [(200, [0.0] * 6), (201, None), (202, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [(f"q{i}", base[i % 30].tolist()) for i in range(60)] + [("q0", base[5].tolist()), ("q0", base[0].tolist())]
    queries = spark.createDataFrame(asked, "query string, q array<float>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 50)
    calls = []
    monkeypatch.setattr(R, "materialise", lambda df, name: calls.append(df.count()) or materialise(df, name))
    got = sorted((r.query, r.vec_id, r.score) for r in R.nearest(vectors, queries, 9).collect())
    want = []
    for name in {n for n, _ in asked}:
        every = [(-R.rounded_cosine(np.float64(v), np.float64(q)), i) for n, q in asked if n == name for i, v in rows[:200] if any(v) and any(q)]
        want += [(name, i, -s) for s, i in sorted(every)[:9]]
    assert got == sorted(want) and calls == [len({tuple(q) for _, q in asked})]
    few = R.nearest(vectors.where("vec_id > 198"), queries.where("query = 'q1'"), 9).collect()
    assert [(r.vec_id, r.score is None) for r in few] == [(199, False), (200, True), (201, True), (202, True)]
    assert R.nearest(vectors.where("false"), queries).count() == R.nearest(vectors, queries.where("false")).count() == 0


def test_chunks_stream(spark):
    """Documents that end anywhere in Arrow's batches are folded as alone, and none is a group of its own, which cost more than its text."""
    rows = [(d, p, "paragraph", f"{d}-{p} " + "x" * (d * 37 % 300), p, 0.9, d % 3 == 0) for d in range(40) for p in range(d % 7 + 1)]
    frame = spark.createDataFrame(rows[::-1], "doc_id long, pos long, element_type string, text string, page int, confidence double, raw boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = K.chunks(frame, 400)
        got = {(r.doc_id, r.chunk_index): (r.elements, r.start_page, r.end_page, r.text, r.flags) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for d in range(40):
        mine = [r for r in rows if r[0] == d]
        for n, at in enumerate(K.fold([r[2] for r in mine], [r[3] for r in mine], 400, 250)):
            text = "\n\n".join(mine[i][3] for i in at)
            want[d, n] = (len(at), at[0], at[-1], text, (["low_text_density"] if len(text) < 20 else []) + (["raw_fallback"] if d % 3 == 0 else []))
    assert got == want
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_bounds_of_all_rows(spark):
    """Bounds are the quantiles of every row; a value of few rows among many copies of others still moves them."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("text_crc32"), F.when(F.col("id") % 3 == 0, F.col("id") * 7919 % 40_009).alias("size"), F.lit(None).cast("string").alias("lang"))
    every = sorted(r[0] for r in rows.where("size is not null").select("size").collect())
    assert H.bounds(rows, ["size", "lang"], 4) == [sorted({every[len(every) * i >> 4] for i in range(1, 16)}), []]


def test_orphans_alone_are_looked_up(spark):
    """Findings that are no orphans don't meet in one task under a key that is null."""
    nodes = spark.range(200).select(F.concat(F.lit("n"), (F.col("id") / 2).cast("int")).alias("dedupe_key"), F.lit("T").alias("node_type"), F.lit("").alias("primary_value"), F.lit("r").alias("run_id"), F.lit("v").alias("schema_version"), F.col("id").alias("seq"))
    rels = spark.createDataFrame([], "dedupe_key string, rel_type string, start_dedupe_key string, end_dedupe_key string, run_id string, schema_version string")
    schema = spark.createDataFrame([("T", "T", "R")], "start_type string, end_type string, rel_type string")
    props = nodes.select("dedupe_key", "node_type", "schema_version", "seq", F.create_map().cast("map<string,string>").alias("properties"))
    df = T.generate(nodes, rels, schema, None, props, {"T": "q"}, "r", "v")
    assert df.groupBy("method").count().count() == 2 and df.where("method = 'orphan_node'").isEmpty()
    assert "__orphan" not in df._jdf.queryExecution().toString()


def test_search_keeps_its_tasks(spark, monkeypatch):
    """Blocks of few bytes are not put together in one task; what compares classes first finds the best, copies included."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 8)).astype(np.float32)
    base[2000:2600] = base[7]
    near = (base[:50] @ base.T).astype(np.float32)
    least = R.floor_of_best(near, 10)
    assert (least <= np.sort(near, axis=1)[:, -10]).all() and (least > np.median(near, axis=1)).all()
    got = list(R.best_of(np.arange(1), base[7:8].astype(np.float64), np.arange(3000), base.astype(np.float64), 5))
    assert got[0][1].tolist() == [7, 2000, 2001, 2002, 2003] and set(got[0][2].tolist()) == {1.0}
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(base[:100])], "vec_id long, embedding array<float>")
    monkeypatch.setattr(R, "VECTOR_BLOCK", 25)
    df = R.nearest(vectors, vectors.where("vec_id < 9").selectExpr("string(vec_id) as query", "embedding as q"), 3)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    assert {r.query for r in df.where("score = 1 and query = vec_id").collect()} == set("012345678")


def test_components_of_long_chain(spark):
    """A chain is halved and more in each round, whatever the order of its keys; a component of many keys is joined from a broadcast."""
    n = 3000
    chain = spark.range(n).select(F.format_string("c%05d", "id").alias("key_a"), F.format_string("c%05d", F.col("id") + 1).alias("key_b"))
    star = spark.range(200).select(F.lit("hub").alias("key_a"), F.format_string("s%03d", "id").alias("key_b"))
    more = spark.createDataFrame([("z", "z"), ("p", None), ("b", "a"), ("a", "b")], "key_a string, key_b string")
    roots = C.components(chain.unionByName(star).unionByName(more), rounds=8)
    got = {r.dedupe_key: r.root for r in roots.collect()}
    assert got == {f"c{i:05d}": "c00000" for i in range(n + 1)} | {f"s{i:03d}": "hub" for i in range(200)} | {"hub": "hub", "z": "z", "a": "a", "b": "a"}


def test_joined_heavy_keys(spark, monkeypatch):
    """Keys of many rows and of few give the same rows, and only the heavy ones are broadcast."""
    monkeypatch.setattr(P, "HEAVY", 50)
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "big").otherwise(F.col("id").cast("string")).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("__n"), F.min("id").alias("least"))
    got = P.joined(rows, facts, "k")
    assert got.columns == ["id", "k", "least"]
    assert {(r.id, r.least) for r in got.collect()} == {(i, 0 if i < 200 else i) for i in range(300)}
    assert "Broadcast" not in P.joined(rows.where("id >= 200"), facts.where("__n = 1"), "k")._jdf.queryExecution().executedPlan().toString()


def test_probable_pairs_are_scored_once(spark, monkeypatch):
    """What is kept is a table, as its context reads it twice."""
    made = []
    monkeypatch.setattr(G, "materialise", lambda df, name, **o: made.append(name) or materialise(df, name, **o))
    nodes = spark.createDataFrame([(f"T|{v}", "T", v, "r", "v", i) for i, v in enumerate(["small ring", "small rings", "the small ring of tin", "bolt"])], "dedupe_key string, node_type string, primary_value string, run_id string, schema_version string, seq long")
    rels = spark.createDataFrame([("e", "T|small ring", "T|bolt")], "dedupe_key string, start_dedupe_key string, end_dedupe_key string")
    df = G.probable_pairs(nodes, rels)
    assert made[-1] == "kept" and "jaro_winkler(" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.key_a, r.key_b, r.method) for r in df.collect()} == {("T|small ring", "T|small rings", G.BY_SIMILARITY), ("T|small ring", "T|the small ring of tin", G.BY_TOKENS)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_references_without_broadcast(spark):
    """Findings are not sent to the driver, however few bytes they have as files."""
    found = spark.range(40).select(F.lit(0).alias("call"), F.col("id").alias("seq"), F.format_string("c%02d", "id").alias("candidate_id"), F.array((F.col("id") / 2).cast("int").cast("string"), F.concat(F.lit("x"), "id")).alias("refs"))
    df = T.packed_batches(materialise(found, "found"))
    assert "Broadcast" not in plan_of(df)
    batches = {}
    for r in df.collect():
        batches.setdefault(r.batch, []).append(r.candidate_id)
    assert sorted(map(len, batches.values())) == [8] * 5


def test_plans_without_broadcast(spark):
    """Of what execution joins only the locks, a row a run, are broadcast."""
    plans = materialise(spark.range(20).selectExpr("id as plan_id", "'r' as run_id", "id as proposal_id", "id as approval_id", "'v' as schema_version", "'d' as diff_id"), "plans")
    allowed = materialise(plans.select("approval_id", "proposal_id"), "approvals")
    proposals = materialise(plans.selectExpr("run_id", "proposal_id", "'approved' as state"), "proposals")
    codes = W.rejections(plans, allowed, proposals, spark.createDataFrame([("r", "v")], "run_id string, version_hash string"))
    assert plan_of(codes).count("BroadcastExchange") <= 1
    nodes = materialise(spark.range(20).selectExpr("concat('n', id) as dedupe_key", "'T' as node_type", "'r' as run_id", "'v' as schema_version", "map('a', '1') as properties"), "nodes")
    rels = materialise(spark.range(9).selectExpr("concat('e', id) as dedupe_key", "'R' as rel_type", "concat('n', id) as start_dedupe_key", "concat('n', id + 1) as end_dedupe_key", "'r' as run_id", "'v' as schema_version", "map('a', '1') as properties"), "rels")
    steps = materialise(plans.selectExpr("plan_id", "0L as step", "if(plan_id = 3, 'delete_node', 'update_node') as operation", "concat('n', plan_id) as dedupe_key", "cast(null as array<string>) as merge_keys", "cast(null as string) as rel_type", "cast(null as string) as start_key", "cast(null as string) as end_key", "map('b', '2') as put", "array('a') as cut"), "steps")
    new, left, record = W.execute(plans, steps, materialise(codes, "codes"), nodes, rels)
    done = plans.select("plan_id")
    for df in (record, X.unmet(steps.join(done.hint("merge"), "plan_id", "left_semi"), nodes, rels), X.executed(proposals, plans), X.graph_invariants({"nodes": nodes, "rels": rels})):
        assert "BroadcastExchange" not in plan_of(df)
    assert record.where("outcome = 'applied'").count() == 20 and new.count() == 19 and left.count() == 7


def test_numbered_deals_rows_once(spark):
    """Places follow from numbers that the written ranges have: no window over all rows."""
    rows = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 37 % 500).alias("v"))
    df = P.numbered(rows, ["k"], ["v"])
    assert "Window" not in plan_of(df)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.v):
        want.setdefault(r.k, []).append(r.v)
    assert {(r.k, r.v, r.place) for r in df.collect()} == {(k, v, i) for k, vs in want.items() for i, v in enumerate(vs)}


def test_last_points(spark):
    """Only points whose id comes again are grouped; of these the last by run and place stays, of null ids too."""
    fields = ["run_id", "chunk_id", "text"]
    points = spark.createDataFrame([("r1", 0, "a", "old"), ("r1", 5, "a", "new"), ("r2", 1, "b", "only"), ("r1", 9, "c", "old"), ("r2", 0, "c", "new"), ("r1", 3, None, "old"), ("r1", 4, None, "new")], "run_id string, place long, chunk_id string, text string")
    assert {(r.chunk_id, r.text) for r in I.last_points(points, fields).collect()} == {("a", "new"), ("b", "only"), ("c", "new"), (None, "new")}


def test_collapse_of_hubs(spark, monkeypatch):
    """A node's relationships are dealt over all tasks, whether it is obsolete or not; what becomes of them is the same."""
    monkeypatch.setattr(P, "HEAVY", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ends = [(f"c{i:03d}", "hub") for i in range(300)] + [("gone", f"d{i:03d}") for i in range(200)] + [("c001", "o1"), ("o1", "o2"), (None, "hub"), (None, "o1"), ("gone", "kept"), ("hub", None)]
        rows = [(f"e{i:03d}", "R", a, b, "r", "v", f"chunk{i}", {"p": str(i), "_k": "x"}) for i, (a, b) in enumerate(ends)]
        rels = spark.createDataFrame(rows, "dedupe_key string, rel_type string, start_dedupe_key string, end_dedupe_key string, run_id string, schema_version string, chunk_id string, properties map<string,string>")
        merges = spark.createDataFrame([("gone", "kept", 1), ("o1", "hub", 2), ("o2", "hub", 3)], "obsolete string, survivor string, nth int")
        hubs = P.heavy_keys(rels.select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("k")), "k")
        assert {r.k for r in hubs.collect()} == {"hub", "gone"}
        facts = merges.select(F.col("obsolete").alias("end_dedupe_key"), "survivor")
        got = P.looked_up(rels, facts, "end_dedupe_key", hubs.withColumnRenamed("k", "end_dedupe_key"), ["start_dedupe_key", "end_dedupe_key"]).withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == len(rows) and {r.dedupe_key: r.survivor for r in got if r.survivor} == {"e500": "hub", "e501": "hub", "e503": "hub"}
        tasks = [r.task for r in got if r.end_dedupe_key == "hub"]
        assert len(set(tasks)) == 4 and max(map(tasks.count, range(4))) < 150
        new, keys = V.collapse(rels, merges)
        got = {(r.start_dedupe_key, r.end_dedupe_key): (r.moved, r.dedupe_key, "_k" in r.properties) for r in new.collect()}
        want = {(a, b): (False, f"e{i:03d}", True) for i, (a, b) in enumerate(ends) if not {a, b} & {"gone", "o1", "o2"}}
        want |= {("kept", f"d{i:03d}"): (True, f"R::kept::d{i:03d}::v1", False) for i in range(200)}
        assert got == want  # c001 to the hub was there before; o1 to o2 and gone to kept are loops; without a start, none is seen to be no loop
        assert keys.where("dedupe_key is not null").count() == 200 + 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
