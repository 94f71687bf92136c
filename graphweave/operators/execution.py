"""Execution of approved plans on a versioned graph: applied beside it, held to its invariants, and swapped in whole."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators import write as W
from graphweave.plans.snapshots import Outcome, Snapshots, Tables, counts
from graphweave.plans.tables import materialise

#: Attempts: without the plans whose steps did not hold in the one before, or on a version that came meanwhile.
ATTEMPTS = 3


def expectations(steps: DataFrame) -> DataFrame:
    """plan_id, step, operation, element, dedupe_key, there: which keys the new graph must have after a step, and which it must
    not: what is created or updated and a merge's survivor, and what is deleted and a merge's other nodes."""
    op = F.col("operation")
    element = F.when(op.isin("create_edge", "update_edge", "delete_edge"), "edge").otherwise("node")
    keys = F.when(op == "merge_nodes", F.transform("merge_keys", lambda k, i: F.struct(k.alias("dedupe_key"), (i == 0).alias("there"))))
    keys = keys.otherwise(F.array(F.struct("dedupe_key", (~op.isin("delete_node", "delete_edge")).alias("there"))))
    return steps.select("plan_id", "step", "operation", element.alias("element"), F.explode(keys).alias("k")).select("plan_id", "step", "operation", "element", "k.*")


def unmet(steps: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """plan_id, step, reason of the steps that the new graph does not bear out. A survivor's relationships also need a key and a
    schema version."""
    have = nodes.select(F.lit("node").alias("element"), "dedupe_key").unionByName(rels.select(F.lit("edge").alias("element"), "dedupe_key")).distinct()
    wanted = expectations(steps).join(have.withColumn("have", F.lit(True)).hint("merge"), ["element", "dedupe_key"], "left")
    wrong = wanted.where(F.col("have").isNotNull() != F.col("there"))
    reason = F.concat_ws(" ", "operation", F.when(F.col("there"), "not_found").otherwise("still_there"), "dedupe_key")
    bare = rels.where("dedupe_key is null or schema_version is null").select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("dedupe_key")).distinct()
    survivors = steps.where("operation = 'merge_nodes'").select("plan_id", "step", F.get("merge_keys", 0).alias("dedupe_key"))
    ungoverned = survivors.join(bare.hint("merge"), "dedupe_key").select("plan_id", "step", F.concat(F.lit("merge_nodes ungoverned "), "dedupe_key").alias("reason"))
    return wrong.select("plan_id", "step", reason.alias("reason")).unionByName(ungoverned)


def graph_invariants(tables: Tables) -> DataFrame:
    """name, broken: relationships whose ends are not nodes, and keys that two nodes have."""
    keys = tables["nodes"].groupBy("dedupe_key").agg(F.count("*").alias("n"))
    ends = tables["rels"].select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("dedupe_key"))
    return counts(ends.join(keys.hint("merge"), "dedupe_key", "left_anti"), "dangling end").unionByName(counts(keys.where("n > 1"), "repeated key"))


def run_plans(graph: Snapshots, plans: DataFrame, steps: DataFrame, approvals: DataFrame, locks: DataFrame, at: datetime, actor: str, dry_run: bool = False, check=graph_invariants) -> tuple[Outcome, DataFrame]:  # noqa: ANN001
    """Execute plans (plan_id, run_id, proposal_id, approval_id, diff_id, schema_version; steps have plan_id and step) on the current
    version's tables nodes, rels, proposals and audit. Returns what became of the swap, and the audit rows that were added.

    Rejected and failed plans change nothing. A plan whose steps the new graph does not bear out has failed, and the others are
    applied without it; where the new graph as a whole breaks an invariant, all plans have failed and the old version is
    served on. Applied plans' proposals become executed. Graph, proposals and audit are swapped in one version, so that after a
    crash either all of it holds or nothing; on a lost race all is done again on the version that won. A dry run adds audit rows
    alone.
    """
    plans, steps = materialise(plans, "plans"), materialise(steps, "steps")
    wrong: DataFrame | None = None
    outcome, rows = Outcome("conflict", graph.version()), None
    for attempt in range(ATTEMPTS):
        last, base = attempt == ATTEMPTS - 1, graph.version()
        now = graph.read(base)
        codes = materialise(W.rejections(plans, approvals, now["proposals"], locks), "codes")
        if wrong is not None:
            codes = codes.join(wrong.hint("merge"), "plan_id", "left").select("plan_id", F.coalesce("code", F.when(F.col("reason").isNotNull(), "invariant_failed")).alias("code"))
        nodes, rels, record = W.execute(plans, steps, codes, now["nodes"], now["rels"], dry_run=dry_run)
        record = materialise(record, "record")
        applied = record.where("outcome = 'applied'").select("plan_id")
        new: Tables = {}
        if not dry_run and not applied.isEmpty():
            new = {"nodes": materialise(nodes, "nodes"), "rels": materialise(rels, "rels")}
            broken = unmet(steps.join(applied.hint("merge"), "plan_id", "left_semi"), new["nodes"], new["rels"]).groupBy("plan_id").agg(F.min("reason").alias("reason"))
            broken = materialise(broken, "broken")
            if not broken.isEmpty():
                wrong = broken if wrong is None else wrong.unionByName(broken)
                if not last:
                    continue
                new = {}  # what is left would need another attempt: nothing of it is applied
            else:
                new["proposals"] = executed(now["proposals"], plans.join(applied.hint("merge"), "plan_id", "left_semi"))
        rows = audit(plans, record, wrong, at, actor, dry_run, bool(new))
        outcome = graph.commit(base, new, check if new else None, {"audit": rows})
        if outcome.state == "broken":
            rows = audit(plans, record, wrong, at, actor, dry_run, False, ", ".join(sorted(outcome.broken)))
            outcome = Outcome("broken", graph.commit(base, {}, None, {"audit": rows}).version, outcome.broken)
        if outcome.state != "conflict":
            break
    return outcome, rows


def executed(proposals: DataFrame, plans: DataFrame) -> DataFrame:
    """Proposals with those of the plans as executed."""
    done = plans.select("run_id", "proposal_id").distinct().withColumn("__done", F.lit(True))
    both = proposals.join(done.hint("merge"), ["run_id", "proposal_id"], "left")
    return both.withColumn("state", F.when(F.col("__done"), "executed").otherwise(F.col("state"))).drop("__done").select(*proposals.columns)


def audit(plans: DataFrame, record: DataFrame, wrong: DataFrame | None, at: datetime, actor: str, dry_run: bool, swapped: bool, broken: str = "") -> DataFrame:
    """One row per plan of what was done: outcome (applied, failed, rejected), steps applied, and why not. A plan that was sound but not
    swapped in has failed."""
    rows = plans.join(record.hint("merge"), "plan_id")
    reasons = wrong if wrong is not None else plans.select("plan_id", F.lit(None).cast("string").alias("reason")).limit(0)
    rows = rows.join(reasons.groupBy("plan_id").agg(F.min("reason").alias("reason")).hint("merge"), "plan_id", "left")
    lost = (F.col("outcome") == "applied") & F.lit(not swapped and not dry_run)
    unborne = F.coalesce(F.col("code") == "invariant_failed", F.lit(False)) | (lost & F.col("reason").isNotNull())
    detail = (
        F.when(unborne, F.concat(F.lit("invariant_failed "), "reason")).when(lost, F.lit(f"not_swapped {broken}".strip()))
        .when(F.lit(dry_run) & (F.col("outcome") == "applied"), "dry_run").otherwise(F.col("code"))
    )
    rows = rows.withColumns({
        "outcome": F.when(unborne | lost, "failed").otherwise(F.col("outcome")), "steps_applied": F.when(unborne | lost, 0).otherwise(F.col("steps_applied")).cast("long"), "detail": detail,
    })
    ids = {c: F.col(c).cast("string") for c in ("proposal_id", "approval_id")}
    out = W.audit_rows(rows.withColumns(ids), F.lit(at), actor)
    return out.select("record_id", "plan_id", "run_id", "proposal_id", "diff_id", "approval_id", "schema_version", "actor", "timestamp_utc", "outcome", "steps_applied", "detail")


def start(graph: Snapshots, nodes: DataFrame, rels: DataFrame, proposals: DataFrame) -> Outcome:
    """The first version, with an empty audit table."""
    schema = (
        "record_id string, plan_id long, run_id string, proposal_id string, diff_id string, approval_id string, schema_version string, actor string, "
        "timestamp_utc string, outcome string, steps_applied long, detail string"
    )
    return graph.commit(graph.version(), {"nodes": nodes, "rels": rels, "proposals": proposals, "audit": graph.spark.createDataFrame([], schema)})


def served(graph: Snapshots) -> tuple[int, Tables]:
    """The number and the tables of the version that readers get."""
    version = graph.version()
    return version.number, graph.read(version)

