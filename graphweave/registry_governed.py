"""Queries of the governed write path, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.text import PROPERTY_NAME
from graphweave.operators import extraction as E
from graphweave.operators import governance as V
from graphweave.operators import reads as R
from graphweave.operators import write as W
from graphweave.plans import model as M
from graphweave.registry_curation import events

Query = Callable[[SparkSession, str], DataFrame]
MAP = "map<string,string>"


def incoming_nodes(s: SparkSession, d: str) -> DataFrame:
    """All nodes as a second run reads them, with properties of their own and of the engine."""
    props = F.create_map(F.lit("seen"), F.col("seq").cast("string"), F.lit("_x"), F.lit("1"))
    return M.nodes(s, d).select("dedupe_key", "node_type", F.lit("run2").alias("run_id"), "schema_version", props.alias("properties"), "seq")


def snapshot_nodes(s: SparkSession, d: str) -> DataFrame:
    """What the first run wrote: a node for every key whose least seq is even."""
    one = M.nodes(s, d).groupBy("dedupe_key", "node_type", "schema_version").agg(F.min("seq").alias("seq")).where("seq % 2 = 0")
    return one.select("dedupe_key", "node_type", F.lit("run1").alias("run_id"), "schema_version", F.create_map(F.lit("old"), F.lit("yes")).alias("properties"))


def incoming_rels(s: SparkSession, d: str) -> DataFrame:
    props = F.create_map(F.lit("new"), F.lit("1"), F.lit("_y"), F.lit("2"))
    return M.more_rels(s, d).select("dedupe_key", "rel_type", "start_dedupe_key", "end_dedupe_key", F.lit("run2").alias("run_id"), "schema_version", props.alias("properties"), F.lit(0).alias("seq"))


def snapshot_rels(s: SparkSession, d: str) -> DataFrame:
    one = M.rels(s, d).where("length(start_dedupe_key) % 2 = 0").distinct()
    return one.select("dedupe_key", "rel_type", "start_dedupe_key", "end_dedupe_key", "run_id", "schema_version", F.create_map(F.lit("old"), F.lit("1")).alias("properties"))


def without_regions(s: SparkSession, d: str) -> DataFrame:
    """Nodes as long as no region is written, so that some ends are missing."""
    return M.nodes(s, d).where("node_type <> 'Region'")


def plans(s: SparkSession, d: str) -> DataFrame:
    """One plan per customer, to update, delete or link it, with all kinds of approvals."""
    c = M.table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("plan_id"), F.concat(F.lit("run"), (k % 3).cast("string")).alias("run_id"), (k - F.when(k % 10 == 3, 1).otherwise(0)).alias("proposal_id"),
        F.when(k % 10 == 1, -1).otherwise(k).alias("approval_id"), F.when(k % 10 == 7, "v0").otherwise("v1").alias("schema_version"), F.sha2(F.concat(F.lit("d"), k.cast("string")), 256).alias("diff_id"), "c_name")


def codes(s: SparkSession, d: str) -> DataFrame:
    c = M.table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    approvals = c.select(F.col("k").alias("approval_id"), F.col("k").alias("proposal_id"))
    proposals = c.where("k % 10 <> 4").select(F.concat(F.lit("run"), (F.col("k") % 3).cast("string")).alias("run_id"), F.col("k").alias("proposal_id"), F.when(F.col("k") % 10 == 5, "pending").otherwise("approved").alias("state"))
    locks = s.createDataFrame([("run0", "v1"), ("run1", "v1")], "run_id string, version_hash string")
    return W.rejections(plans(s, d), approvals, proposals, locks)


def steps(s: SparkSession, d: str) -> DataFrame:
    """Even plans rename their customer, those of 3 mod 4 delete it, the others update a key that is not there."""
    k = F.col("plan_id")
    p = plans(s, d)
    op = F.when(k % 4 == 3, "delete_node").otherwise("update_node")
    key = F.when(k % 4 == 1, F.lit("Customer|nobody|v1")).otherwise(M.node_key("Customer", F.col("c_name")))
    none = F.lit(None)
    return p.select("plan_id", op.alias("operation"), key.alias("dedupe_key"), none.cast("array<string>").alias("merge_keys"), none.cast("string").alias("rel_type"), none.cast("string").alias("start_key"),
                    none.cast("string").alias("end_key"), F.create_map(F.lit("name"), F.lit("NEW")).alias("put"), F.array(F.lit("old")).alias("cut"))


def graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    props = F.create_map(F.lit("name"), F.col("primary_value"), F.lit("old"), F.lit("1"))
    nodes = M.nodes(s, d).where("node_type in ('Customer', 'Nation')").select("dedupe_key", "node_type", "run_id", "schema_version", props.alias("properties"))
    rels = M.rels(s, d).where("start_dedupe_key like 'Customer|%'").distinct().withColumn("properties", F.create_map().cast(MAP))
    return nodes, rels


def executed(s: SparkSession, d: str, dry_run: bool = False) -> DataFrame:
    nodes, rels, record = W.execute(plans(s, d), steps(s, d), codes(s, d), *graph(s, d), dry_run=dry_run)
    rows = record.select(F.col("plan_id").cast("string").alias("id"), F.concat_ws(" ", "outcome", F.col("steps_applied").cast("string"), "code").alias("what"))
    rows = rows.unionByName(nodes.where("node_type = 'Customer'").select(F.col("dedupe_key").alias("id"), F.concat(F.lit("node "), F.element_at("properties", "name"), F.coalesce(F.element_at("properties", "old"), F.lit(""))).alias("what")))
    return rows.unionByName(rels.select(F.col("dedupe_key").alias("id"), F.lit("rel").alias("what")))


def amendments(s: SparkSession, d: str) -> DataFrame:
    """Requests of all kinds: one per part, of which many are alike."""
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    asked = M.table(s, d, "part").select(
        F.concat(F.lit("run"), (k % 3).cast("string")).alias("run_id"), pick("LOCATED_IN", "SERVES", "PART_OF", "NEAR", "OWNS").alias("rel_type"),
        pick("Customer", "Nation", "Supplier", "Planet").alias("start_type"), pick("Nation", "Region", "Nation", "Customer", "Nation", "Region", "Supplier").alias("end_type"), k.alias("seq"))
    runs = s.createDataFrame([("run0",), ("run1",)], "run_id string")
    types = runs.crossJoin(s.createDataFrame([("Customer",), ("Nation",), ("Supplier",), ("Region",)], "type string"))
    edges = runs.crossJoin(M.schema_edges(s))
    before = s.createDataFrame([("run0", "NEAR", "Nation", "Nation")], "run_id string, rel_type string, start_type string, end_type string")
    return W.amend_schema(asked, runs, types, edges, before)


def proposals(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).withColumns({"run_id": F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")), "proposal_class": F.col("class"), "candidate_id": F.col("event_id") % 500})


def queries() -> dict[str, Query]:
    t = M.table

    def merged(s: SparkSession, d: str) -> DataFrame:
        out, acts = W.merge_nodes(snapshot_nodes(s, d), incoming_nodes(s, d))
        p = lambda k: F.element_at("properties", k).alias(k)
        return out.join(acts, "dedupe_key", "left").select("dedupe_key", "run_id", p("old"), p("seen"), p("_x"), "created", "matched")

    def linked(s: SparkSession, d: str) -> DataFrame:
        out, acts = W.merge_edges(snapshot_rels(s, d), incoming_rels(s, d), without_regions(s, d))
        rows = acts.select(F.concat_ws(" ", "rel_type", "start_dedupe_key", "end_dedupe_key").alias("what"), "created", "matched", "skipped")
        more = out.select(F.concat_ws(" ", "dedupe_key", "run_id", F.array_join(F.map_keys("properties"), ",")).alias("what"), *[F.lit(0).cast("long").alias(c) for c in ("created", "matched", "skipped")])
        return rows.unionByName(more)

    def written(s: SparkSession, d: str) -> DataFrame:
        regions = incoming_nodes(s, d).where("node_type <> 'Region'")
        return W.write_result(snapshot_nodes(s, d).where("node_type <> 'Region'"), snapshot_rels(s, d), regions, incoming_rels(s, d))[2]

    def updated(s: SparkSession, d: str) -> DataFrame:
        asked = M.rels(s, d).select("dedupe_key").distinct().withColumn("dedupe_key", F.when(F.length("dedupe_key") % 5 == 0, F.concat("dedupe_key", F.lit("x"))).otherwise(F.col("dedupe_key")))
        return W.update_outcomes(M.rels(s, d), asked)

    def created(s: SparkSession, d: str) -> DataFrame:
        asked = M.more_rels(s, d).select("dedupe_key", F.when(F.length("dedupe_key") % 7 == 0, "").otherwise(F.col("rel_type")).alias("rel_type"), F.col("start_dedupe_key").alias("start_key"), F.col("end_dedupe_key").alias("end_key")).distinct()
        return W.create_outcomes(asked, M.rels(s, d), without_regions(s, d))

    def named(s: SparkSession, d: str) -> DataFrame:
        names = t(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.concat(F.when(F.col("p_partkey") % 3 == 0, "_").otherwise("9"), "p_type")).alias("name"))
        return names.select("p_partkey", E.identifier_guard(F.col("name")).alias("type_ok"), E.identifier_guard(F.col("name"), PROPERTY_NAME).alias("property_ok"))

    def audited(s: SparkSession, d: str) -> DataFrame:
        p = plans(s, d).withColumn("approval_id", F.when(F.col("plan_id") % 6 == 0, "").otherwise(F.concat(F.lit("a"), F.col("plan_id").cast("string")))).withColumn("proposal_id", F.col("diff_id"))
        p = p.withColumn("diff_id", F.when(F.col("plan_id") % 8 == 0, F.substring("diff_id", 1, 8)).otherwise(F.col("diff_id")))
        at = F.when(F.col("plan_id") % 9 > 0, F.expr("timestamp'2024-05-06 07:08:09' + make_interval(0, 0, 0, 0, 0, 0, plan_id)"))
        return W.audit_rows(p, at, "ann").select("plan_id", "timestamp_utc", "record_id", F.array_join("errors", ",").alias("errors"))

    def locked(s: SparkSession, d: str) -> DataFrame:
        asked = t(s, d, "customer").select(F.concat(F.lit("run"), (F.col("c_custkey") % 40).cast("string")).alias("run_id"), F.sha2(F.col("c_name"), 256).alias("version_hash"), F.col("c_custkey").alias("seq"))
        have = asked.where("seq < 5").select("run_id", F.lit("old").alias("version_hash"))
        locks, out = W.lock_schema(asked, have)
        return out.select("run_id", "seq", "outcome").unionByName(locks.select("run_id", F.lit(-1).cast("long").alias("seq"), F.col("version_hash").alias("outcome")))

    def excluded(s: SparkSession, d: str) -> DataFrame:
        c = lambda where: proposals(s, d).where(where).select("candidate_id")
        return W.exclude(c("candidate_id < 40"), c("state = 'excluded'"), c("candidate_id % 7 = 0"))

    def proposed(s: SparkSession, d: str) -> DataFrame:
        packets = t(s, d, "customer").select(F.concat(F.lit("run"), (F.col("c_custkey") % 3).cast("string")).alias("run_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("candidate_id"), F.lit("merge").alias("proposal_class"))
        have = packets.where("length(candidate_id) = 3").select(F.sha2(F.to_json(F.struct("candidate_id", "proposal_class", "run_id")), 256).alias("proposal_id"))
        return W.propose(packets, have, s.createDataFrame([("run0", "v1"), ("run1", "v2")], "run_id string, version_hash string"))

    def once(s: SparkSession, d: str) -> DataFrame:
        """Proposals are created once: those that are there stay as they are."""
        p = proposals(s, d)
        new, clash = V.append_once(p.where("event_id % 4 = 0").select("proposal_id"), p.select("proposal_id", "state"), "proposal_id")
        return new.select("proposal_id", F.lit("created").alias("outcome")).unionByName(clash.select("proposal_id", F.lit("existing").alias("outcome")))

    def cleared(s: SparkSession, d: str) -> DataFrame:
        p = proposals(s, d)
        return W.clear_run("run1", proposals=p, candidates=p.select("run_id", "candidate_id").distinct(), excluded=p.where("state = 'excluded'"))[1]

    def moves(to: str) -> Query:
        return lambda s, d: V.move(proposals(s, d).select("proposal_id", F.lit(to).alias("wanted")), proposals(s, d)).select("proposal_id", "outcome")

    return {
        "dml_merge_nodes_snapshot": merged,
        "dml_merge_edges": linked,
        "dml_write_result": written,
        "dml_update_edge": updated,
        "dml_create_edge": created,
        "flt_identifier_guard": named,
        "join_approval": codes,
        "gov_execute": executed,
        "dml_dry_run": lambda s, d: executed(s, d, dry_run=True),
        "gov_audit_make": audited,
        "gov_schema_lock": locked,
        "gov_schema_amend": amendments,
        "dml_exclude": excluded,
        "gov_propose_manual": proposed,
        "dml_proposal_create": once,
        "gov_clear_run": cleared,
        "dml_proposal_clear": lambda s, d: W.clear_run("run1", proposals=proposals(s, d))[0]["proposals"].groupBy("run_id").agg(F.count("*").alias("n")),
        "gov_reject": moves("rejected"), "gov_defer": moves("deferred"), "gov_exclude": moves("excluded"), "gov_restore": moves("pending"),
        "gov_list_proposals": lambda s, d: proposals(s, d).where("run_id = 'run1'").orderBy("event_id").select("proposal_id", "state"),
        "gov_list_excluded": lambda s, d: proposals(s, d).where("run_id = 'run1' and state = 'excluded'").select("proposal_id", "candidate_id"),
        "src_proposals": lambda s, d: proposals(s, d).where("run_id = 'run2'").orderBy("event_id").select("proposal_id", "proposal_class"),
        "src_audit": lambda s, d: events(s, d).where("event_type = 'purchase'").orderBy("ts", "event_id").select("event_id", "user_id"),
        "agg_ui_rollups": lambda s, d: R.rollups(proposals(s, d)),
        "agg_unique_candidates": lambda s, d: proposals(s, d).agg(F.countDistinct("candidate_id").alias("n")),
        "prj_proposal_out": lambda s, d: proposals(s, d).select("proposal_id", "candidate_id", "proposal_class", "state"),
        "st_agent_stages": lambda s, d: M.table(s, d, "events").groupBy((F.col("event_id") % 1000).alias("candidate_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("updated_at")),
    }


_KEYS = ", one AS (SELECT dedupe_key AS k, min(seq) AS least, max(seq) AS last, count(*) AS n FROM nodes GROUP BY 1) "
_EDGES = M.MORE_RELS_SQL + """, held AS (SELECT DISTINCT dedupe_key AS k, rel_type AS t, start_dedupe_key AS a, end_dedupe_key AS b FROM rels
  WHERE length(start_dedupe_key) % 2 = 0),
  keys AS (SELECT DISTINCT dedupe_key AS k FROM nodes WHERE node_type <> 'Region'),
  seen AS (SELECT rel_type, start_dedupe_key, end_dedupe_key, min(dedupe_key) AS dedupe_key, count(*) AS n, start_dedupe_key IN (SELECT k FROM keys)
    AND end_dedupe_key IN (SELECT k FROM keys) AS ok,
    EXISTS (SELECT 1 FROM held WHERE t = rel_type AND a = start_dedupe_key AND b = end_dedupe_key) AS old FROM more_rels GROUP BY 1, 2, 3) """
_PLANS = """WITH p AS (SELECT c_custkey AS k, 'run' || (c_custkey % 3) AS run_id, c_name,
    CASE WHEN c_custkey % 10 = 1 THEN 'approval_not_found' WHEN c_custkey % 10 = 3 THEN 'approval_mismatch'
      WHEN c_custkey % 10 = 4 THEN 'proposal_not_found'
      WHEN c_custkey % 10 = 5 THEN 'proposal_not_approved' WHEN c_custkey % 3 = 2 THEN 'schema_not_locked'
        WHEN c_custkey % 10 = 7 THEN 'schema_version_mismatch' END AS code FROM customer) """
_STATE = """WITH pr AS (SELECT event_id AS proposal_id, event_id, event_id % 500 AS candidate_id, 'run' || (event_id % 3) AS run_id, ['pending',
  'approved', 'executed', 'rejected', 'deferred', 'excluded'][user_id % 6 + 1] AS state,
    ['merge', 'delete', 'rename', 'normalize', 'canonicalize', 'defer', 'none'][event_id % 7 + 1] AS proposal_class FROM events) """


def _moves(*sources: str) -> str:
    return _STATE + f"SELECT proposal_id, CASE WHEN state IN ({', '.join(map(repr, sources))}) THEN 'moved' ELSE 'illegal' END AS outcome FROM pr"


def _executed(done: str, gone: str, new: str) -> str:
    return _PLANS + f""", c AS (SELECT *, {gone} AS gone, {new} AS renamed FROM p)
      SELECT CAST(k AS VARCHAR) AS id, {done} AS what FROM c
      UNION ALL SELECT 'Customer|' || c_name || '|v1', 'node ' || CASE WHEN renamed THEN 'NEW' ELSE c_name || '1' END FROM c WHERE NOT gone
      UNION ALL SELECT 'LOCATED_IN::Customer|' || c.c_name || '|v1::Nation|' || n_name || '|v1::v1', 'rel' FROM c JOIN customer ON c_custkey = k
        JOIN nation ON c_nationkey = n_nationkey WHERE NOT gone"""


def oracle_sql() -> dict[str, str]:
    g = M.SQL
    return {
        "dml_merge_nodes_snapshot": g + _KEYS + """SELECT k AS dedupe_key, 'run2' AS run_id, CASE WHEN least % 2 = 0 THEN 'yes' END AS old, CASE
          WHEN least % 2 = 1 THEN CAST(least AS VARCHAR) END AS seen,
          CAST(NULL AS VARCHAR) AS _x, least % 2 AS created, n - least % 2 AS matched FROM one""",
        "dml_merge_edges": g + _EDGES + """SELECT rel_type || ' ' || start_dedupe_key || ' ' || end_dedupe_key AS what, (ok
          AND NOT old)::BIGINT AS created, CASE WHEN ok THEN n - (NOT old)::INT ELSE 0 END AS matched,
            CASE WHEN ok THEN 0 ELSE n END AS skipped FROM seen
          UNION ALL SELECT k || ' run1 old', 0, 0, 0 FROM held UNION ALL SELECT dedupe_key || ' run2 new', 0, 0, 0 FROM seen WHERE ok AND NOT old""",
        "dml_write_result": g + _KEYS.replace("FROM nodes", "FROM nodes WHERE node_type <> 'Region'") + _EDGES + """SELECT 'node' AS element, 'created' AS action,
          CAST(sum(least % 2) AS BIGINT) AS n FROM one
          UNION ALL SELECT 'node', 'matched', CAST(sum(n - least % 2) AS BIGINT) FROM one UNION ALL SELECT 'edge', 'created', count(*) FROM seen
            WHERE ok AND NOT old
          UNION ALL SELECT 'edge', 'matched', CAST(coalesce(sum(n - (NOT old)::INT), 0) AS BIGINT) FROM seen WHERE ok UNION ALL SELECT 'edge',
            'skipped', CAST(coalesce(sum(n), 0) AS BIGINT) FROM seen WHERE NOT ok""",
        "dml_update_edge": g + """SELECT DISTINCT CASE WHEN length(dedupe_key) % 5 = 0 THEN dedupe_key || 'x' ELSE dedupe_key END AS dedupe_key, CASE
          WHEN length(dedupe_key) % 5 = 0 THEN 'missing' ELSE 'updated' END AS outcome FROM rels""",
        "dml_create_edge": g + M.MORE_RELS_SQL + """SELECT DISTINCT dedupe_key, CASE WHEN length(dedupe_key) % 7 = 0 THEN 'incomplete'
          WHEN end_dedupe_key LIKE 'Region|%' THEN 'missing_endpoint'
          WHEN rel_type = 'SERVES' THEN 'created' ELSE 'matched' END AS outcome FROM more_rels""",
        "flt_identifier_guard": """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE CASE
          WHEN p_partkey % 3 = 0 THEN '_' ELSE '9' END || p_type END AS name FROM part)
          SELECT p_partkey, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]*') AS type_ok, regexp_full_match(name,
            '[A-Za-z_][A-Za-z0-9_]*') AS property_ok FROM n""",
        "join_approval": _PLANS + "SELECT k AS plan_id, code FROM p",
        "gov_execute": _executed("CASE WHEN code IS NOT NULL THEN 'rejected 0 ' || code WHEN k % 4 = 1 THEN 'failed 0 no_such_element' ELSE 'applied 1' END", "code IS NULL AND k % 4 = 3", "code IS NULL AND k % 2 = 0"),
        "dml_dry_run": _executed("CASE WHEN code IS NOT NULL THEN 'rejected 0 ' || code ELSE 'applied 0' END", "false", "false"),
        "gov_audit_make": """WITH a AS (SELECT c_custkey AS k, 'run' || (c_custkey % 3) AS run_id, sha256('d' || c_custkey) AS d, CASE
          WHEN c_custkey % 6 = 0 THEN '' ELSE 'a' || c_custkey END AS approval,
            CASE WHEN c_custkey % 9 > 0 THEN strftime(TIMESTAMP '2024-05-06 07:08:09' + to_seconds(c_custkey), '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS ts
              FROM customer),
          b AS (SELECT *, CASE WHEN k % 8 = 0 THEN d[1:8] ELSE d END AS diff FROM a)
          SELECT k AS plan_id, ts AS timestamp_utc,
            sha256('{"approval_id":"' || approval || '","diff_id":"' || diff || '","proposal_id":"' || d || '","run_id":"' || run_id || '"' || coalesce(',"timestamp_utc":"' || ts || '"', '') || '}') AS record_id,
            concat_ws(',', CASE WHEN approval = '' THEN 'approval_id' END, CASE WHEN length(diff) <> 64 THEN 'diff_id' END, CASE
              WHEN ts IS NULL THEN 'timestamp' END) AS errors FROM b""",
        "gov_schema_lock": """SELECT 'run' || (c_custkey % 40) AS run_id, c_custkey AS seq, CASE WHEN c_custkey < 40 AND c_custkey >= 5 THEN 'locked'
          ELSE 'already_locked' END AS outcome FROM customer
          UNION ALL SELECT 'run' || c_custkey, -1, CASE WHEN c_custkey < 5 THEN 'old' ELSE sha256(c_name) END FROM customer WHERE c_custkey < 40""",
        "gov_schema_amend": f"""WITH a AS (SELECT p_partkey AS seq, 'run' || (p_partkey % 3) AS run_id, ['LOCATED_IN', 'SERVES', 'PART_OF', 'NEAR',
          'OWNS'][p_partkey % 5 + 1] AS rel_type,
            ['Customer', 'Nation', 'Supplier', 'Planet'][p_partkey % 4 + 1] AS start_type, ['Nation', 'Region', 'Nation', 'Customer', 'Nation',
              'Region', 'Supplier'][p_partkey % 7 + 1] AS end_type FROM part),
          o AS (SELECT *, CASE WHEN run_id = 'run2' THEN 'schema_not_locked' WHEN start_type = 'Planet' THEN 'undefined_node_type'
            WHEN (start_type, end_type, rel_type) IN ({", ".join(map(str, M.SCHEMA_EDGES))}) THEN 'edge_already_in_schema'
            WHEN (run_id, rel_type, start_type, end_type) = ('run0', 'NEAR', 'Nation', 'Nation') OR seq > min(seq) OVER (PARTITION BY run_id,
              rel_type, start_type, end_type) THEN 'existing' ELSE 'amended' END AS outcome FROM a)
          SELECT run_id, rel_type, start_type, end_type, seq, outcome, CASE WHEN outcome IN ('existing',
            'amended') THEN sha256(run_id || chr(0) || rel_type || chr(0) || start_type || chr(0) || end_type) END AS amendment_id FROM o""",
        "dml_exclude": _STATE + "SELECT DISTINCT candidate_id FROM pr WHERE (candidate_id < 40 OR state = 'excluded') AND candidate_id % 7 <> 0",
        "gov_propose_manual": """WITH p AS (SELECT 'run' || (c_custkey % 3) AS run_id, 'c' || c_custkey AS candidate_id, 'merge' AS proposal_class
          FROM customer)
          SELECT *, sha256('{"candidate_id":"' || candidate_id || '","proposal_class":"merge","run_id":"' || run_id || '"}') AS proposal_id,
            CASE run_id WHEN 'run0' THEN 'v1' WHEN 'run1' THEN 'v2' END AS schema_version,
            CASE WHEN run_id = 'run2' THEN 'schema_not_locked' WHEN length(candidate_id) = 3 THEN 'existing' ELSE 'created' END AS outcome FROM p""",
        "dml_proposal_create": "SELECT event_id AS proposal_id, CASE WHEN event_id % 4 = 0 THEN 'existing' ELSE 'created' END AS outcome FROM events",
        "gov_clear_run": _STATE + """SELECT 'proposals' AS name, count(*) AS removed FROM pr WHERE run_id = 'run1' UNION ALL SELECT 'candidates',
          count(DISTINCT candidate_id) FROM pr WHERE run_id = 'run1' UNION ALL SELECT 'excluded', count(*) FROM pr WHERE run_id = 'run1'
          AND state = 'excluded'""",
        "dml_proposal_clear": _STATE + "SELECT run_id, count(*) AS n FROM pr WHERE run_id <> 'run1' GROUP BY 1",
        "gov_reject": _moves("pending"), "gov_defer": _moves("pending"), "gov_exclude": _moves("pending"), "gov_restore": _moves("deferred", "excluded"),
        "gov_list_proposals": _STATE + "SELECT proposal_id, state FROM pr WHERE run_id = 'run1'",
        "gov_list_excluded": _STATE + "SELECT proposal_id, candidate_id FROM pr WHERE run_id = 'run1' AND state = 'excluded'",
        "src_proposals": _STATE + "SELECT proposal_id, proposal_class FROM pr WHERE run_id = 'run2'",
        "src_audit": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
        "agg_ui_rollups": _STATE + """SELECT 'state' AS dimension, state AS value, count(*) AS n FROM pr GROUP BY 2 UNION ALL SELECT 'class',
          proposal_class, count(*) FROM pr GROUP BY 2""",
        "agg_unique_candidates": _STATE + "SELECT count(DISTINCT candidate_id) AS n FROM pr",
        "prj_proposal_out": _STATE + "SELECT proposal_id, candidate_id, proposal_class, state FROM pr",
        "st_agent_stages": "SELECT event_id % 1000 AS candidate_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS updated_at FROM events GROUP BY 1",
    }
