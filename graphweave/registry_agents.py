"""Queries of versioned execution, indexing, retrieval, parsing, replies and state machines, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave import registry_documents as RD
from graphweave import registry_governed as RG
from graphweave.functions.names import title_case
from graphweave.functions.numbers import round_exact
from graphweave.functions.replies import reply_error, strip_code_fence, taken
from graphweave.operators import batches as B
from graphweave.operators import execution as X
from graphweave.operators import indexing as I
from graphweave.operators import machine as S
from graphweave.operators import reads as R
from graphweave.operators import retrieval as Q
from graphweave.plans import model as M
from graphweave.plans.snapshots import Snapshots
from graphweave.plans.tables import shared_dir
from graphweave.sources import keyed as KV
from graphweave.sources import parsing as P
from graphweave.streaming import states as ST

Query = Callable[[SparkSession, str], DataFrame]
AT = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def approvals(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approvals, proposals and locks behind the plans."""
    k = F.col("c_custkey")
    c = M.table(s, d, "customer")
    proposals = c.where("c_custkey % 10 <> 4").select(F.concat(F.lit("run"), (k % 3).cast("string")).alias("run_id"), k.alias("proposal_id"), F.when(k % 10 == 5, "pending").otherwise("approved").alias("state"))
    return c.select(k.alias("approval_id"), k.alias("proposal_id")), proposals, s.createDataFrame([("run0", "v1"), ("run1", "v1")], "run_id string, version_hash string")


def steps(s: SparkSession, d: str) -> DataFrame:
    """One step a plan; plans of 18 mod 20 also update the customer after theirs, which another plan deletes."""
    one = RG.steps(s, d).withColumn("step", F.lit(0).cast("long"))
    k = F.col("c_custkey")
    after = M.table(s, d, "customer").where("c_custkey % 20 = 19").select((k - 1).alias("plan_id"), M.node_key("Customer", F.col("c_name")).alias("dedupe_key"))
    more = after.join(one.drop("dedupe_key", "step").hint("merge"), "plan_id").withColumn("step", F.lit(1).cast("long"))
    return one.unionByName(more)


def execution(s: SparkSession, d: str, broken: bool = False) -> DataFrame:
    """What is served after plans were executed, and what the audit says. Where the graph holds a relationship that leads nowhere, the
    version is refused, and readers get the old one."""
    graph = Snapshots(s, folder(s, "graph"))
    nodes, rels = RG.graph(s, d)
    nodes = nodes.dropDuplicates(["dedupe_key"])
    if broken:
        rels = rels.unionByName(rels.orderBy("dedupe_key").limit(1).withColumns({"dedupe_key": F.lit("to nowhere"), "end_dedupe_key": F.lit("Nation|none|v1")}))
    allowed, proposals, locks = approvals(s, d)
    X.start(graph, nodes, rels, proposals)
    plans = RG.plans(s, d).drop("c_name")
    X.run_plans(graph, plans, steps(s, d), allowed, locks, AT, "ann")
    number, now = X.served(graph)
    rows = now["audit"].select(F.col("plan_id").cast("string").alias("id"), F.concat_ws(" ", "outcome", F.col("steps_applied").cast("string"), "detail").alias("what"))
    rows = rows.unionByName(now["nodes"].where("node_type = 'Customer'").select(F.col("dedupe_key").alias("id"), F.concat(F.lit("node "), F.element_at("properties", "name")).alias("what")))
    states = now["proposals"].select(F.concat(F.lit("proposal "), F.col("proposal_id").cast("string")).alias("id"), F.col("state").alias("what"))
    return rows.unionByName(states).unionByName(s.range(1).select(F.lit("version").alias("id"), F.lit(str(number)).alias("what")))


def toy_vectors():  # noqa: ANN201
    def embed(texts: list[str]) -> list[list[float]]:
        """Lengths in place of a model's vectors; a text with a copyright sign can't be embedded."""
        if any("©" in t or "copyright" in t.lower() for t in texts):
            raise ValueError("no vector for this text")
        return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]

    return embed


def indexed(s: SparkSession, d: str) -> DataFrame:
    """All chunks are indexed twice, and read back: the second call changes nothing."""
    index = Snapshots(s, folder(s, "index"))
    for _ in range(2):
        I.index_chunks(index, RD.chunks(s, d), toy_vectors(), 3)
    now = index.read()
    points = now["points"].select("chunk_id", "run_id", *[F.get("vector", i).cast("long").alias(f"v{i}") for i in range(3)])
    wrong = now["errors"].select(
        F.concat_ws(" ", F.lit("batch"), F.col("batch").cast("string"), "stage", "error").alias("chunk_id"), "run_id", F.col("first").alias("v0"), F.col("last").alias("v1"), F.lit(-1).cast("long").alias("v2"))
    return points.unionByName(wrong)


def rounds(s: SparkSession, d: str) -> DataFrame:
    """Every 50th customer as a candidate, and in each round another vector as its query; those of 150 make no query in round 2."""
    k, v = F.col("c_custkey"), M.table(s, d, "embeddings")
    n = v.agg(F.max("vec_id")).first()[0] + 1
    mine = M.table(s, d, "customer").where("c_custkey % 50 = 0")
    candidates = mine.select(k.alias("candidate_id"), (k % 4 / 10).alias("baseline"), (k % 3 * 400 + 200).cast("long").alias("budget"), (k % 4).cast("long").alias("max_rounds"))
    kinds = F.array(*map(F.lit, ("supporting", "corroborating", "conflicting", "other")))
    items = mine.select(k.alias("candidate_id"), F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("pos")).select(
        "candidate_id", "pos", ((F.col("candidate_id") * 7 + F.col("pos")) % n).alias("chunk_id"), F.get(kinds, (F.col("pos") + F.col("candidate_id")).cast("int") % 4).alias("classification"))

    def ask(open_: DataFrame) -> DataFrame:
        c, r = F.col("candidate_id"), F.col("round")
        text = F.when((c % 150 == 0) & (r == 2), F.lit("")).otherwise(((c * 7 + (r - 1) * 3) % n).cast("string"))
        return open_.select("candidate_id", text.alias("query"))

    def search(asked: DataFrame) -> DataFrame:
        wanted = asked.select("query").distinct().join(v.select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("q")), "query")
        return R.nearest(v, wanted, Q.TOP).join(asked, "query").select("candidate_id", F.col("vec_id").alias("chunk_id"), "score")

    ends, each = Q.retrieve(candidates, items, ask, search, 3)
    rows = ends.select("candidate_id", F.lit(0).alias("round"), F.concat_ws(" ", "stop", F.col("exhausted").cast("string"), F.col("sufficient").cast("string")).alias("what"), F.col("n_items").alias("n"), "budget_left", F.round("score", 6).alias("score"))
    return rows.unionByName(each.select("candidate_id", "round", F.concat(F.lit("new: "), F.array_join(F.array_sort("chunk_ids").cast("array<string>"), ",")).alias("what"), F.size("chunk_ids").cast("long").alias("n"), "budget_left", F.lit(None).cast("double").alias("score")))


def tiers():  # noqa: ANN201
    def whole(content: bytes, name: str) -> str:
        """Only what is closed as a page ought to be."""
        if not content.endswith(b"</body></html>"):
            raise ValueError("page is cut off")
        text = content.decode()
        return text[text.index("<article>") + 9 : text.index("</article>")]

    def body(content: bytes, name: str) -> str:
        text = content.decode()
        at = text.find("<article>")
        if at < 0 or "<table" in text or len(text) % 7 == 0:
            raise ValueError("no plain article")
        return text[at + 9 :]

    return [("whole", whole), ("body", body), ("raw_text", P.raw_text)]


def parsed(s: SparkSession, d: str) -> DataFrame:
    """Pages of which every other is cut somewhere, and every 29th is blank, through three tiers."""
    k = F.col("page_id")
    html = F.when(k % 29 == 0, " ").when(k % 2 == 0, F.substring("html", F.lit(1), (F.char_length("html") * (k % 10 + 1) / 11).cast("int"))).otherwise(F.col("html"))
    pages = M.table(s, d, "pages").select(k.alias("doc_id"), F.col("url").alias("name"), F.encode(html, "UTF-8").alias("content"))
    got = P.parse_chain(pages, tiers())
    reasons = F.array_join(F.transform("attempts", lambda a: F.concat(a.parser, F.lit(": "), a.reason)), "; ")
    return got.select("doc_id", "parser", F.coalesce("tier", F.lit(-1)).alias("tier"), F.sha2("text", 256).alias("text_sha256"), reasons.alias("attempts"), "error")


ASKED = T.StructType([
    T.StructField("label", T.StringType(), False), T.StructField("count", T.LongType(), False), T.StructField("score", T.DoubleType(), True),
    T.StructField("refs", T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False)])), False)])


def replies(s: SparkSession, d: str) -> DataFrame:
    """Replies about parts, each third in a fence, and of all kinds that are wrong."""
    k = F.col("p_partkey")
    count = F.when(k % 11 == 1, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))).when(k % 11 == 2, F.lit("2.5")).otherwise(F.col("p_size").cast("string"))
    score = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit(', "score": null')).when(k % 5 == 2, F.lit(', "score": 1')).otherwise(F.lit(', "score": 0.25'))
    more = F.when(k % 11 == 3, F.lit(', "more": true')).otherwise(F.lit(""))
    refs = F.when(k % 11 == 4, F.lit('[{"key": 1}]')).when(k % 11 == 5, F.lit('{"key": "a"}')).when(k % 11 == 6, F.lit("[]")).otherwise(F.lit('[{"key": "a"}, {"key": "b"}]'))
    text = F.concat(F.lit('{"label": "'), F.col("p_name"), F.lit('", "count": '), count, score, more, F.lit(', "refs": '), refs, F.lit("}"))
    text = F.when(k % 11 == 7, F.substring(text, F.lit(1), F.char_length(text) - 3)).when(k % 11 == 8, F.concat(text, F.lit(" done"))).otherwise(text)
    text = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("  "), text, F.lit("\n"))).otherwise(text)
    return M.table(s, d, "part").select(k.alias("k"), text.alias("reply"))


def decoded(s: SparkSession, d: str) -> DataFrame:
    checked = replies(s, d).withColumn("error", reply_error(F.col("reply"), ASKED))
    return checked.withColumn("x", taken(F.col("reply"), F.col("error"), ASKED)).select("k", "error", "x.label", F.coalesce("x.count", F.lit(-1)).alias("count"), "x.score", F.array_join("x.refs.key", ",").alias("refs"))


def rekeyed(s: SparkSession, d: str) -> DataFrame:
    """Customers in batches of 20, whose replies leave some out, name others twice, and some that nobody asked for; every 7th
    batch's reply is cut off, and every 11th never came."""
    k = F.col("c_custkey")
    c = M.table(s, d, "customer").select((k / 20).cast("long").alias("batch"), k, F.concat(F.lit("c"), k.cast("string")).alias("id"))
    again = c.where("c_custkey % 20 < 5").withColumn("score", F.lit("0.9"))
    said = c.where("c_custkey % 10 <> 3").withColumn("score", (k % 13 / 10).cast("string")).unionByName(again)
    said = said.unionByName(c.where("c_custkey % 20 = 9").withColumns({"id": F.concat("id", F.lit("x")), "score": F.lit("0.1")}))
    item = F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", "score": '), F.col("score"), F.lit("}"))
    order = F.struct(F.when(F.col("score") == "0.9", 1).otherwise(0).alias("late"), k.alias("k"), F.col("id"), item.alias("item"))
    one = said.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.item), ", ").alias("items"))
    text = F.concat(F.lit('{"results": ['), F.col("items"), F.lit("]}"))
    text = F.when(F.col("batch") % 7 == 3, F.substring(text, F.lit(1), F.char_length(text) - 5)).otherwise(text)
    schema = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    out, unknown = B.rekeyed(c.select("batch", "id"), one.where("batch % 11 <> 5").select("batch", text.alias("reply")), schema, "id", F.col("item.score") <= 1, F.struct(F.col("id"), F.lit(0.0)))
    rows = out.select("id", "outcome", F.col("item.score").alias("score"), B.routed(F.col("item.score")).alias("route"))
    return rows.unionByName(unknown.select("id", F.lit("unknown").alias("outcome"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("route")))


WANTED = ("approved", "deferred", "pending", "pending", "excluded", "executed", "pending")


def machine_events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as moves of the users' proposals; every user under 5 of 6 is known."""
    wanted = F.array(*map(F.lit, WANTED))
    e = M.table(s, d, "events")
    moves = e.select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), F.get(wanted, ((F.col("event_id") * 31 + F.col("user_id")) % 7).cast("int")).alias("wanted"))
    known = e.select(F.col("user_id").alias("proposal_id")).distinct().where("proposal_id % 6 < 5")
    return moves, known.withColumns({"state": F.lit("pending"), "last_seq": F.lit(None).cast("long")})


def machine(s: SparkSession, d: str) -> DataFrame:
    """In two batches, as in one."""
    moves, known = machine_events(s, d)
    middle = moves.agg(F.expr("max(seq) div 2")).first()[0] or 0
    now, first = S.fold(moves.where(F.col("seq") <= middle), known)
    now, then = S.fold(moves.where(F.col("seq") > middle), now)
    ends = now.select("proposal_id", F.lit(-1).cast("long").alias("seq"), "state", F.lit("").alias("outcome"))
    return ends.unionByName(first.unionByName(then).select("proposal_id", "seq", "state", "outcome"))


def cooled(s: SparkSession, d: str) -> DataFrame:
    """Clicks as calls, purchases as executions of their run: what a run may do again, and when."""
    e = M.table(s, d, "events").withColumn("run_id", F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")))
    calls = e.where("event_type = 'click'").select(F.col("event_id").alias("call_id"), "run_id", F.col("ts").alias("at"))
    locks = s.createDataFrame([("run0",), ("run1",), ("run2",)], "run_id string")
    return S.guarded(calls, e.where("event_type = 'purchase'").select("run_id", F.col("ts").alias("at")), locks, 600).fillna(0, ["retry_after"])


def expired(s: SparkSession, d: str) -> DataFrame:
    """Events as tokens of their users that hold for some minutes or days: those that hold at the last event."""
    entry = lambda df: df.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("set_at"), (F.col("event_id") % 5 * 86_400 + 600).cast("double").alias("ttl_s"))
    got = ST.expiring_stream(s, d, "events.parquet", folder(s, "tokens"), entry)
    return got["keys"].select("key", "value", F.unix_micros("expires_at").alias("expires_at"))


def streamed(s: SparkSession, d: str) -> DataFrame:
    """The same events as gov_machine, as a stream."""
    known = machine_events(s, d)[1]
    wanted = F.array(*map(F.lit, WANTED))
    moves = lambda e: e.select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), F.get(wanted, ((F.col("event_id") * 31 + F.col("user_id")) % 7).cast("int")).alias("wanted"))
    got = ST.proposal_stream(s, d, "events.parquet", folder(s, "moves"), known, moves)
    ends = got["states"].select("proposal_id", F.lit(-1).cast("long").alias("seq"), "state", F.lit("").alias("outcome"))
    return ends.unionByName(got["steps"].select("proposal_id", "seq", "state", "outcome"))


def scanned(s: SparkSession, d: str) -> DataFrame:
    """Keys of all chunks' jobs, laid out in their order; the keys under one prefix are read from few files."""
    jobs = RD.jobs(s, d).select(F.concat_ws(":", F.lit("job"), "run_id", F.lpad(F.col("doc_id").cast("string"), 8, "0"), "chunk_id").alias("key"), "status")
    where = folder(s, "keys")
    KV.store(jobs, where)
    return KV.scan(s, where, "job:run1:0000").unionByName(KV.scan(s, where, "job:run2:"))


def stored_twice(s: SparkSession, d: str) -> DataFrame:
    """Manifests are stored, some again with another hash, and all again: a document's files are replaced."""
    where, held = folder(s, "artefacts"), RD.held(s, d).select("run_id", "doc_id", "content_hash", "n_chunks")
    KV.store_documents(held, where)
    KV.store_documents(held.where("doc_id % 10 = 0").withColumn("content_hash", F.lit("new")), where)
    KV.store_documents(held.where("doc_id % 20 = 0").withColumn("content_hash", F.lit("new")), where)
    return s.read.parquet(where).select("run_id", "doc_id", "content_hash", "n_chunks")


def queries() -> dict[str, Query]:
    t = M.table
    return {
        "gov_execute_versioned": execution,
        "gov_execute_broken": lambda s, d: execution(s, d, broken=True),
        "dml_index_chunks": indexed,
        "ag_retrieval_loop": rounds,
        "src_parse_chain": parsed,
        "fn_strip_code_fence": lambda s, d: replies(s, d).select("k", F.sha2(strip_code_fence(F.col("reply")), 256).alias("inner_sha256")),
        "fn_decode_reply": decoded,
        "join_llm_by_id": rekeyed,
        "gov_machine": machine,
        "st_cooldown": cooled,
        "st_expiry": expired,
        "st_proposal_stream": streamed,
        "src_key_scan": scanned,
        "dml_store_json": stored_twice,
        "fn_round": lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", round_exact(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"), 6).alias("price"), round_exact(F.col("l_extendedprice").cast("double") / 7000, 2).alias("share")),
        "fn_title_case": lambda s, d: t(s, d, "part").select("p_partkey", title_case(F.concat("p_type", F.lit(" o'"), "p_name", F.lit("-3rd "))).alias("title")),
    }


def _execution(what: str, renamed: str, gone: str, state: str) -> str:
    return RG._PLANS + f""", n AS (SELECT p.*, q.k AS next, 'Customer|' || q.c_name || '|v1' AS next_key, q.k IS NOT NULL AND q.code IS NULL AND p.code IS NULL AS unmet
        FROM p LEFT JOIN p q ON q.k = p.k + 1 AND p.k % 20 = 18),
      o AS (SELECT *, code IS NULL AND k % 4 <> 1 AND NOT unmet AS applied FROM n),
      f AS (SELECT o.*, coalesce(b.applied, false) AS by_other FROM o LEFT JOIN o b ON b.next = o.k)
      SELECT CAST(k AS VARCHAR) AS id, CASE WHEN code IS NOT NULL THEN 'rejected 0 ' || code WHEN k % 4 = 1 THEN 'failed 0 no_such_element'
        WHEN unmet THEN 'failed 0 invariant_failed update_node not_found ' || next_key ELSE {what} END AS what FROM f
      UNION ALL SELECT 'Customer|' || c_name || '|v1', 'node ' || CASE WHEN {renamed} THEN 'NEW' ELSE c_name END FROM f WHERE NOT ({gone})
      UNION ALL SELECT 'proposal ' || k, {state} FROM f WHERE k % 10 <> 4
      UNION ALL SELECT 'version', '1'"""


_HELD = "CASE WHEN k % 10 = 5 THEN 'pending' ELSE 'approved' END"
_ROUNDS = """WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
  c AS (SELECT c_custkey AS k, (c_custkey % 4)::DOUBLE / 10 AS base, c_custkey % 3 * 400 + 200 AS b0, c_custkey % 4 AS most FROM customer WHERE c_custkey % 50 = 0),
  items AS (SELECT k, pos, (k * 7 + pos) % n AS chunk, list_extract([0.3::DOUBLE, 0.15, 0.1, 0.0], (pos + k) % 4 + 1)::DOUBLE AS w FROM c, n, unnest(range(0, k % 3 + 1)) AS u(pos)),
  own AS (SELECT k, list(w ORDER BY pos) AS ws, count(*) AS held FROM items GROUP BY k),
  q AS (SELECT k, r, (k * 7 + (r - 1) * 3) % n AS v, k % 150 = 0 AND r = 2 AS blank FROM c, n, unnest([1, 2, 3]) AS u(r)),
  near AS (SELECT a.v, e.vec_id FROM (SELECT DISTINCT v FROM q) a JOIN embeddings x ON x.vec_id = a.v, embeddings e
    QUALIFY row_number() OVER (PARTITION BY a.v ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 5) DESC, e.vec_id) <= 10),
  hits AS (SELECT k, r, vec_id FROM q JOIN near USING (v) WHERE NOT blank),
  fresh AS (SELECT k, r, vec_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.k = h.k AND i.chunk = h.vec_id)
    AND NOT EXISTS (SELECT 1 FROM hits e WHERE e.k = h.k AND e.r < h.r AND e.vec_id = h.vec_id)),
  per AS (SELECT k, r, blank, count(vec_id) AS f, coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id), '') AS list FROM q LEFT JOIN fresh USING (k, r) GROUP BY k, r, blank),
  run AS (SELECT per.*, base, b0, most, ws, held, sum(f) OVER (PARTITION BY k ORDER BY r) AS total, greatest(b0 - 500 * (r - 1), 0) AS before FROM per JOIN c USING (k) JOIN own USING (k)),
  scored AS (SELECT *, least(1.0, list_reduce(list_concat([base], ws, list_transform(range(0, total::BIGINT), lambda i: 0.15::DOUBLE)), lambda a, b: a + b)) AS score,
    least(1.0, list_reduce(list_concat([base], ws, list_transform(range(0, (total - f)::BIGINT), lambda i: 0.15::DOUBLE)), lambda a, b: a + b)) AS score_before FROM run),
  stops AS (SELECT *, CASE WHEN most < r THEN 'rounds' WHEN before <= 0 THEN 'budget' WHEN blank THEN 'voluntary' WHEN r = 1 AND f = 0 THEN 'exhausted' WHEN score >= 0.6 THEN 'sufficient'
    WHEN most = r THEN 'rounds' END AS stop, most >= r AND before > 0 AND NOT blank AS went FROM scored),
  ended AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN r END) OVER (PARTITION BY k) AS last FROM stops)
  SELECT k AS candidate_id, 0 AS round, stop || ' ' || (CASE WHEN went THEN total ELSE total - f END = 0) || ' ' || (CASE WHEN went THEN score ELSE score_before END >= 0.6) AS what,
    CAST(held + CASE WHEN went THEN total ELSE total - f END AS BIGINT) AS n, CAST(CASE WHEN went THEN greatest(before - 500, 0) ELSE before END AS BIGINT) AS budget_left,
    round(CASE WHEN went THEN score ELSE score_before END, 6) AS score FROM ended WHERE r = last
  UNION ALL SELECT k, r, 'new: ' || CASE WHEN went THEN list ELSE '' END, CASE WHEN went THEN f ELSE 0 END, CASE WHEN went THEN greatest(before - 500, 0) ELSE before END, NULL
    FROM ended WHERE r <= last AND (went OR stop = 'voluntary')"""
_PARSED = """WITH h AS (SELECT page_id AS k, CASE WHEN page_id % 29 = 0 THEN ' ' WHEN page_id % 2 = 0 THEN substring(html, 1, length(html) * (page_id % 10 + 1) // 11) ELSE html END AS t FROM pages),
  p AS (SELECT k, t, strpos(t, '<article>') AS a, strpos(t, '</article>') AS z FROM h),
  w AS (SELECT *, CASE WHEN NOT ends_with(t, '</body></html>') THEN 'page is cut off' WHEN a = 0 OR z = 0 THEN 'substring not found' WHEN trim(t[a + 9:z - 1]) = '' THEN 'empty_text' END AS e1,
    CASE WHEN a = 0 OR contains(t, '<table') OR length(t) % 7 = 0 THEN 'no plain article' WHEN trim(t[a + 9:]) = '' THEN 'empty_text' END AS e2, CASE WHEN trim(t) = '' THEN 'empty_text' END AS e3 FROM p),
  o AS (SELECT *, CASE WHEN e1 IS NULL THEN 0 WHEN e2 IS NULL THEN 1 WHEN e3 IS NULL THEN 2 END AS tier FROM w)
  SELECT k AS doc_id, ['whole', 'body', 'raw_text'][tier + 1] AS parser, coalesce(tier, -1) AS tier, sha256(CASE tier WHEN 0 THEN t[a + 9:z - 1] WHEN 1 THEN t[a + 9:] WHEN 2 THEN t END) AS text_sha256,
    concat_ws('; ', 'whole: ' || e1, CASE WHEN e1 IS NOT NULL THEN 'body: ' || e2 END, CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN 'raw_text: ' || e3 END) AS attempts,
    CASE WHEN tier IS NULL THEN 'all_parsers_failed' END AS error FROM o"""
_REPLY = """WITH r AS (SELECT p_partkey AS k, p_name, p_size, '{"label": "' || p_name || '", "count": ' || CASE p_partkey % 11 WHEN 1 THEN '"' || p_size || '"' WHEN 2 THEN '2.5' ELSE p_size::VARCHAR END
    || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ', "score": null' WHEN 2 THEN ', "score": 1' ELSE ', "score": 0.25' END || CASE WHEN p_partkey % 11 = 3 THEN ', "more": true' ELSE '' END
    || ', "refs": ' || CASE p_partkey % 11 WHEN 4 THEN '[{"key": 1}]' WHEN 5 THEN '{"key": "a"}' WHEN 6 THEN '[]' ELSE '[{"key": "a"}, {"key": "b"}]' END || '}' AS t FROM part),
  reply AS (SELECT *, CASE k % 11 WHEN 7 THEN t[1:length(t) - 3] WHEN 8 THEN t || ' done' ELSE t END AS inner_text FROM r) """
_WRONG = "CASE WHEN NOT json_valid(inner_text) THEN 'json' WHEN k % 11 IN (1, 2, 3, 4, 5) THEN 'fields' END"


def oracle_sql() -> dict[str, str]:
    ok, allowed = f"{_WRONG} IS NULL", f"(w.state, e.wanted) IN ({', '.join(map(str, sorted(S.ALLOWED)))})"
    walked = f"""WITH RECURSIVE e AS (SELECT user_id AS p, event_id AS seq, ['approved', 'deferred', 'pending', 'pending', 'excluded', 'executed', 'pending'][(event_id * 31 + user_id) % 7 + 1] AS wanted,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
          walk AS (SELECT DISTINCT p, 0::BIGINT AS i, -1::BIGINT AS seq, '' AS before, 'pending' AS state, '' AS outcome FROM e WHERE p % 6 < 5
            UNION ALL SELECT w.p, e.i, e.seq, w.state, CASE WHEN {allowed} THEN e.wanted ELSE w.state END, CASE WHEN {allowed} THEN 'moved' ELSE 'illegal' END
            FROM walk w JOIN e ON e.p = w.p AND e.i = w.i + 1)
          SELECT p AS proposal_id, seq, before AS state, outcome FROM walk WHERE i > 0
          UNION ALL SELECT p, -1, max_by(state, i), '' FROM walk GROUP BY p
          UNION ALL SELECT p, seq, NULL, 'unknown' FROM e WHERE p % 6 = 5"""
    return {
        "gov_execute_versioned": _execution("'applied ' || (1 + (next IS NOT NULL)::INT)", "applied AND k % 2 = 0 OR by_other", "applied AND k % 4 = 3", f"CASE WHEN applied THEN 'executed' ELSE {_HELD} END"),
        "gov_execute_broken": _execution("'failed 0 not_swapped dangling end'", "false", "false", _HELD),
        "dml_index_chunks": RD._C + """, placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY doc_id, chunk_index) - 1 AS place FROM chunk),
          b AS (SELECT *, place // 100 AS batch, bool_or(contains(text, '©') OR contains(lower(text), 'copyright')) OVER (PARTITION BY run_id, place // 100) AS bad FROM placed)
          SELECT chunk_id, run_id, length(text) AS v0, length(text) - length(replace(text, ' ', '')) AS v1, length(text) - length(replace(text, 'e', '')) AS v2 FROM b WHERE NOT bad
          UNION ALL SELECT 'batch ' || batch || ' embedding no vector for this text', run_id, min(place), max(place), -1 FROM b WHERE bad GROUP BY run_id, batch""",
        "ag_retrieval_loop": _ROUNDS,
        "src_parse_chain": _PARSED,
        "fn_strip_code_fence": _REPLY + "SELECT k, sha256(inner_text) AS inner_sha256 FROM reply",
        "fn_decode_reply": _REPLY + f"""SELECT k, {_WRONG} AS error, CASE WHEN {ok} THEN p_name END AS label, CASE WHEN {ok} THEN p_size ELSE -1 END AS count,
          CASE WHEN {ok} AND k % 5 > 1 THEN CASE k % 5 WHEN 2 THEN 1.0 ELSE 0.25 END END::DOUBLE AS score, CASE WHEN {ok} THEN CASE k % 11 WHEN 6 THEN '' ELSE 'a,b' END END AS refs FROM reply""",
        "join_llm_by_id": """WITH c AS (SELECT c_custkey AS k, c_custkey // 20 AS batch, 'c' || c_custkey AS id FROM customer),
          o AS (SELECT *, batch % 11 <> 5 AND batch % 7 <> 3 AS read, CASE WHEN k % 20 < 5 THEN 0.9 WHEN k % 10 <> 3 THEN (k % 13)::DOUBLE / 10 END AS said FROM c),
          r AS (SELECT *, CASE WHEN NOT read THEN 'refused' WHEN said IS NULL THEN 'missing' WHEN said > 1 THEN 'rejected' ELSE 'taken' END AS outcome FROM o),
          s AS (SELECT id, outcome, CASE WHEN outcome = 'taken' THEN said ELSE 0.0 END::DOUBLE AS score FROM r)
          SELECT *, CASE WHEN score >= 0.6 THEN 'propose' ELSE 'retrieve' END AS route FROM s
          UNION ALL SELECT id || 'x', 'unknown', NULL, NULL FROM r WHERE read AND k % 20 = 9""",
        "gov_machine": walked, "st_proposal_stream": walked,
        "st_expiry": """WITH e AS (SELECT *, ts + to_seconds(event_id % 5 * 86400 + 600) AS until FROM events),
          l AS (SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_type)) AS value, arg_max(until, (ts, event_type)) AS until FROM e GROUP BY 1)
          SELECT key, value, epoch_us(until) AS expires_at FROM l WHERE until > (SELECT max(ts) FROM events)""",
        "st_cooldown": """WITH e AS (SELECT *, 'run' || (user_id % 4) AS run_id FROM events),
          ran AS (SELECT DISTINCT run_id, ts AS ran FROM e WHERE event_type = 'purchase'),
          c AS (SELECT e.event_id, e.run_id, 600 - (epoch_us(ts) - epoch_us(ran)) / 1e6 AS left_s FROM (SELECT * FROM e WHERE event_type = 'click') e ASOF LEFT JOIN ran ON ran.run_id = e.run_id AND e.ts >= ran.ran)
          SELECT event_id AS call_id, CASE WHEN left_s > 0 THEN 'execution_cooldown' WHEN run_id = 'run3' THEN 'schema_not_locked' ELSE 'ok' END AS outcome,
            CASE WHEN left_s > 0 THEN CAST(floor(left_s) + 1 AS BIGINT) ELSE 0 END AS retry_after FROM c""",
        "src_key_scan": RD._C + """, k AS (SELECT 'job:' || run_id || ':' || lpad(doc_id::VARCHAR, 8, '0') || ':' || chunk_id AS key, status FROM job)
          SELECT * FROM k WHERE starts_with(key, 'job:run1:0000') OR starts_with(key, 'job:run2:')""",
        "dml_store_json": RD._C + """SELECT c.run_id, c.doc_id, CASE WHEN c.doc_id % 10 = 0 THEN 'new' ELSE sha256(coalesce(d.text, '')) END AS content_hash, count(*) AS n_chunks
          FROM chunk c JOIN documents d USING (doc_id) GROUP BY c.run_id, c.doc_id, d.text""",
        "fn_round": """SELECT l_orderkey, l_linenumber, CAST(printf('%.6f', CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS DOUBLE) AS price,
          CAST(printf('%.2f', CAST(l_extendedprice AS DOUBLE) / 7000) AS DOUBLE) AS share FROM lineitem""",
        "fn_title_case": """WITH x AS (SELECT p_partkey, trim(p_type || ' o''' || p_name || '-3rd ') AS s FROM part)
          SELECT p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(s[i - 1:i - 1], '[A-Za-z]')
            THEN lower(s[i:i]) ELSE upper(s[i:i]) END), '') AS title FROM x""",
    }
