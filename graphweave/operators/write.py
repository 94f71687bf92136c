"""The governed write path: merges into a snapshot, approvals, execution of plans, audit, schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.operators import governance as V
from graphweave.plans.tables import materialise

MAP = "map<string,string>"


def user_properties(props: Column) -> Column:
    """Without names that begin with _, which are the engine's."""
    return F.map_filter(F.coalesce(props, F.create_map().cast(MAP)), lambda k, _: ~F.startswith(k, F.lit("_")))


def merge_nodes(snapshot: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new snapshot, and dedupe_key, action for every incoming row's key: created once, matched for each further row.

    Nodes have dedupe_key, node_type, run_id, schema_version, properties; incoming rows also seq, their order. The
    first properties stay (an old snapshot's before all), the last run and seq stamp the node.
    """
    new = incoming.groupBy("dedupe_key").agg(
        F.min_by(F.struct("node_type", "schema_version", user_properties(F.col("properties")).alias("properties")), "seq").alias("first"),
        F.max_by("run_id", "seq").alias("last_run"), F.max("seq").alias("last_seen"), F.count("*").alias("n"))
    old = snapshot.select("dedupe_key", F.struct("node_type", "schema_version", "properties").alias("old"), F.col("run_id").alias("old_run"))
    both = old.join(new, "dedupe_key", "full")
    body = F.coalesce("old", "first").alias("x")
    out = both.select("dedupe_key", body, F.coalesce("last_run", "old_run").alias("run_id"), "last_seen").select(
        "dedupe_key", "x.node_type", "run_id", "x.schema_version", "x.properties", "last_seen")
    seen = both.where("n is not null").select("dedupe_key", F.col("old").isNull().cast("long").alias("created"), "n")
    return out, seen.select("dedupe_key", "created", (F.col("n") - F.col("created")).alias("matched"))


def merge_edges(snapshot: DataFrame, incoming: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new snapshot, and rel_type, start_dedupe_key, end_dedupe_key with created, matched and skipped rows.

    Rows whose ends are not both nodes, of whatever run, are skipped. One relationship per type and ends: the first
    row's key and properties stay (an old snapshot's before all).
    """
    ends = ["rel_type", "start_dedupe_key", "end_dedupe_key"]
    keys = nodes.select("dedupe_key").distinct()
    rows = incoming
    for end in ("start", "end"):
        rows = rows.join(keys.select(F.col("dedupe_key").alias(f"{end}_dedupe_key"), F.lit(True).alias(f"__{end}")).hint("merge"), f"{end}_dedupe_key", "left")
    held = F.col("__start").isNotNull() & F.col("__end").isNotNull()
    body = F.struct("dedupe_key", "run_id", "schema_version", user_properties(F.col("properties")).alias("properties"))
    seen = rows.groupBy(*ends, held.alias("held")).agg(F.min_by(body, F.struct("seq", "dedupe_key")).alias("first"), F.count("*").alias("n"))
    old = snapshot.select(*ends, F.struct("dedupe_key", "run_id", "schema_version", "properties").alias("old"))
    same = old.select(*[F.col(c).alias(f"__{c}") for c in ends], "old")
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ends]
    both = seen.join(same.hint("merge"), match, "left").drop(*[f"__{c}" for c in ends])
    new = both.where("held and old is null").select(*ends, "first.*")
    created = F.when(F.col("held") & F.col("old").isNull(), 1).otherwise(0).cast("long")
    held, n = F.col("held"), F.col("n")
    actions = both.select(*ends, created.alias("created"), F.when(held, n - created).otherwise(0).alias("matched"), F.when(held, 0).otherwise(n).cast("long").alias("skipped"))
    return old.select(*ends, "old.*").unionByName(new), actions


def write_result(nodes: DataFrame, rels: DataFrame, new_nodes: DataFrame, new_rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes first, then relationships between what is there: both new snapshots (nodes as a table, since the
    relationships are checked on them), and element, action, n."""
    merged, acts = merge_nodes(nodes, new_nodes)
    merged = materialise(merged, "nodes")
    linked, links = merge_edges(rels, new_rels, merged)
    total = lambda df, what, *names: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).select(
        F.lit(what).alias("element"), F.explode(F.array(*[F.struct(F.lit(c).alias("action"), F.col(c).alias("n")) for c in names])).alias("x")).select("element", "x.*")
    return merged, linked, total(acts, "node", "created", "matched").unionByName(total(links, "edge", "created", "matched", "skipped"))


def update_outcomes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """dedupe_key, outcome of changes: updated, or missing where no row has the key, which fails the step."""
    have = rows.select("dedupe_key").distinct().withColumn("have", F.lit(True))
    return changes.join(have, "dedupe_key", "left").select("dedupe_key", F.when(F.col("have"), "updated").otherwise("missing").alias("outcome"))


def create_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """seq, dedupe_key, outcome of requests to create nodes (seq, dedupe_key, node_type): incomplete without a key or a type, matched
    where the key is there already or an earlier complete request has made it, else created."""
    have = nodes.select("dedupe_key").distinct().withColumn("have", F.lit(True))
    whole = (F.coalesce("dedupe_key", F.lit("")) != "") & (F.coalesce("node_type", F.lit("")) != "")
    first = requests.where(whole).groupBy("dedupe_key").agg(F.min("seq").alias("first"))
    rows = requests.join(have, "dedupe_key", "left").join(first, "dedupe_key", "left")
    outcome = F.when(~whole, "incomplete").when(F.col("have") | (F.col("seq") > F.col("first")), "matched").otherwise("created")
    return rows.select("seq", "dedupe_key", outcome.alias("outcome"))


def create_outcomes(requests: DataFrame, rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """dedupe_key, outcome of requests to create relationships (dedupe_key, rel_type, start_key, end_key): created, matched
    where type and ends are there already, missing_endpoint, or incomplete where a field is blank."""
    keys = nodes.select("dedupe_key").distinct()
    rows = requests
    for end in ("start", "end"):
        rows = rows.join(keys.select(F.col("dedupe_key").alias(f"{end}_key"), F.lit(True).alias(f"__{end}")), f"{end}_key", "left")
    have = rels.select("rel_type", F.col("start_dedupe_key").alias("start_key"), F.col("end_dedupe_key").alias("end_key")).distinct().withColumn("have", F.lit(True))
    rows = rows.join(have, ["rel_type", "start_key", "end_key"], "left")
    blank = [F.coalesce(c, F.lit("")) == "" for c in ("rel_type", "start_key", "end_key")]
    outcome = F.when(blank[0] | blank[1] | blank[2], "incomplete").when(F.col("__start").isNull() | F.col("__end").isNull(), "missing_endpoint").when(F.col("have"), "matched").otherwise("created")
    return rows.select("dedupe_key", outcome.alias("outcome"))


def rejections(plans: DataFrame, approvals: DataFrame, proposals: DataFrame, schema: DataFrame) -> DataFrame:
    """plan_id, code: the first reason not to execute a plan (plan_id, run_id, proposal_id, approval_id, schema_version), or
    null. Approvals, proposals and locked schemas are unique per id, (run, id) and run."""
    rows = plans.join(approvals.select("approval_id", F.col("proposal_id").alias("__for")).hint("merge"), "approval_id", "left")
    rows = rows.join(proposals.select("run_id", "proposal_id", F.coalesce("state", F.lit("")).alias("__state")).hint("merge"), ["run_id", "proposal_id"], "left")
    rows = rows.join(schema.select("run_id", F.col("version_hash").alias("__version")), "run_id", "left")
    code = (
        F.when(F.col("__for").isNull(), "approval_not_found").when(F.col("__for") != F.col("proposal_id"), "approval_mismatch")
        .when(F.col("__state").isNull(), "proposal_not_found").when(F.col("__state") != "approved", "proposal_not_approved")
        .when(F.col("__version").isNull(), "schema_not_locked").when(F.col("__version") != F.col("schema_version"), "schema_version_mismatch")
    )
    return rows.select("plan_id", code.alias("code"))


def applied(nodes: DataFrame, rels: DataFrame, steps: DataFrame, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Both snapshots after all steps (operation, dedupe_key, merge_keys, rel_type, start_key, end_key, put, cut).

    Kinds of steps are applied as sets: updates, creations of relationships between nodes that are there, merges,
    deletions. Steps of different proposals must not touch one element, which grouping by shared references sees to.
    """
    of = lambda op: steps.where(F.col("operation") == op)
    change = lambda op: of(op).select("dedupe_key", "put", "cut").dropDuplicates(["dedupe_key"])
    nodes = V.update_nodes(nodes, change("update_node"))
    rels = V.update_nodes(rels, change("update_edge"))
    made = of("create_edge").select(
        "dedupe_key", "rel_type", F.col("start_key").alias("start_dedupe_key"), F.col("end_key").alias("end_dedupe_key"), "run_id",
        F.lit(version).alias("schema_version"), F.lit(None).cast(MAP).alias("properties"), F.lit(0).alias("seq"))
    rels, _ = merge_edges(rels, made, nodes)
    others = F.slice("merge_keys", 2, F.greatest(F.size("merge_keys"), F.lit(1)))
    merges = of("merge_nodes").select(F.col("dedupe_key").alias("survivor"), F.posexplode(others).alias("nth", "obsolete")).dropDuplicates(["obsolete"])
    rels, _ = V.collapse(rels.withColumn("chunk_id", F.lit(None).cast("string")), merges, version)
    gone = of("delete_node").select("dedupe_key").unionByName(merges.select(F.col("obsolete").alias("dedupe_key")))
    nodes, rels = V.delete_nodes(nodes, rels, gone)
    return nodes, V.delete_edges(rels, of("delete_edge"))


def audit_rows(plans: DataFrame, at: Column, actor: str) -> DataFrame:
    """record_id and errors beside plans (run_id, proposal_id, diff_id, approval_id, outcome, steps): the id is the hash of
    the canonical JSON; an empty approval, actor or a hash of another length is an error, and so is a missing time."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    record = F.to_json(F.struct("approval_id", "diff_id", "proposal_id", "run_id", stamp.alias("timestamp_utc")))
    checks = {"actor": F.lit(actor) != "", "approval_id": F.coalesce("approval_id", F.lit("")) != "", "diff_id": F.length("diff_id") == 64, "timestamp": at.isNotNull()}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return plans.withColumns({"timestamp_utc": stamp, "actor": F.lit(actor), "record_id": F.sha2(record, 256), "errors": broken})


def execute(plans: DataFrame, steps: DataFrame, codes: DataFrame, nodes: DataFrame, rels: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both snapshots after the accepted plans, and plan_id, outcome, steps_applied, code.

    A rejected plan changes nothing. A plan that updates a key which is not there fails, and nothing of it is applied:
    all or nothing, as a snapshot takes the old one's place only whole. A dry run applies nothing and says so.
    """
    # all sides grow with the plans: small as files, they would be large broadcasts
    good = plans.join(codes.where("code is null").select("plan_id").hint("merge"), "plan_id", "left_semi")
    mine = steps.join(good.select("plan_id", "run_id").hint("merge"), "plan_id")
    update = mine.where(F.col("operation").isin("update_node", "update_edge"))
    have = nodes.select("dedupe_key").unionByName(rels.select("dedupe_key")).distinct()
    failed = materialise(update.join(have.hint("merge"), "dedupe_key", "left_anti").select("plan_id").distinct(), "failed")
    sound = materialise(mine.join(failed.hint("merge"), "plan_id", "left_anti"), "sound")
    count = sound.groupBy("plan_id").agg(F.count("*").alias("n"))
    rows = plans.join(codes.hint("merge"), "plan_id").join(failed.withColumn("failed", F.lit(True)).hint("merge"), "plan_id", "left").join(count.hint("merge"), "plan_id", "left")
    outcome = F.when(F.col("code").isNotNull(), "rejected").when(F.col("failed") & F.lit(not dry_run), "failed").otherwise("applied")
    done = F.when((outcome == "applied") & F.lit(not dry_run), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    record = rows.select("plan_id", outcome.alias("outcome"), done.alias("steps_applied"), F.coalesce("code", F.when(F.col("failed") & F.lit(not dry_run), "no_such_element")).alias("code"))
    if dry_run:
        return nodes, rels, record
    return *applied(nodes, rels, sound), record


def lock_schema(proposals: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The locks after proposals (run_id, version_hash, seq), and outcome per proposal: locked for a run's first, else
    already_locked."""
    held = locks.select("run_id").distinct().withColumn("held", F.lit(True))
    first = proposals.groupBy("run_id").agg(F.min_by("version_hash", "seq").alias("version_hash"), F.min("seq").alias("first"))
    new = first.join(held, "run_id", "left_anti")
    rows = proposals.join(new.select("run_id", "first"), "run_id", "left")
    outcome = F.when(F.col("first") == F.col("seq"), "locked").otherwise("already_locked")
    return locks.select("run_id", "version_hash").unionByName(new.select("run_id", "version_hash")), rows.select("run_id", "seq", outcome.alias("outcome"))


def amend_schema(requests: DataFrame, locks: DataFrame, types: DataFrame, edges: DataFrame, amendments: DataFrame) -> DataFrame:
    """Outcome and amendment_id of requests (run_id, rel_type, start_type, end_type, seq): schema_not_locked,
    undefined_node_type, edge_already_in_schema, existing (amended before, or by an earlier request), or amended."""
    key = ["run_id", "rel_type", "start_type", "end_type"]
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    rows = requests.join(flag(locks.select("run_id"), "locked"), "run_id", "left")
    for end in ("start_type", "end_type"):
        rows = rows.join(flag(types.select("run_id", F.col("type").alias(end)), f"__{end}"), ["run_id", end], "left")
    rows = rows.join(flag(edges.select(*key), "base"), key, "left").join(flag(amendments.select(*key), "before"), key, "left")
    rows = rows.join(requests.groupBy(*key).agg(F.min("seq").alias("first")), key)
    outcome = (
        F.when(F.col("locked").isNull(), "schema_not_locked").when(F.col("__start_type").isNull() | F.col("__end_type").isNull(), "undefined_node_type")
        .when(F.col("base"), "edge_already_in_schema").when(F.col("before") | (F.col("seq") > F.col("first")), "existing").otherwise("amended")
    )
    ident = F.sha2(F.concat_ws("\0", *key), 256)
    return rows.select(*key, "seq", outcome.alias("outcome"), F.when(outcome.isin("existing", "amended"), ident).alias("amendment_id"))


def exclude(excluded: DataFrame, add: DataFrame, restore: DataFrame) -> DataFrame:
    """The excluded candidates after some were added and others restored."""
    every = excluded.select("candidate_id").unionByName(add.select("candidate_id")).distinct()
    return every.join(restore.select("candidate_id").distinct(), "candidate_id", "left_anti")


def propose(packets: DataFrame, held: DataFrame, locks: DataFrame) -> DataFrame:
    """Outcome of manual proposals (run_id, candidate_id, proposal_class): their id is the hash of those as canonical JSON;
    schema_not_locked without a lock, existing where a proposal has the id, else created with the lock's version."""
    ident = F.sha2(F.to_json(F.struct("candidate_id", "proposal_class", "run_id")), 256)
    rows = packets.withColumn("proposal_id", ident).join(locks.select("run_id", F.col("version_hash").alias("schema_version")), "run_id", "left")
    rows = rows.join(held.select("proposal_id").distinct().withColumn("held", F.lit(True)), "proposal_id", "left")
    outcome = F.when(F.col("schema_version").isNull(), "schema_not_locked").when(F.col("held"), "existing").otherwise("created")
    return rows.select("run_id", "candidate_id", "proposal_class", "proposal_id", "schema_version", outcome.alias("outcome"))


def clear_run(run: str, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without a run's rows, and name, removed."""
    left = {name: df.where(~F.col("run_id").eqNullSafe(F.lit(run))) for name, df in tables.items()}
    counts = [df.agg(F.count_if(F.col("run_id").eqNullSafe(F.lit(run))).alias("removed")).select(F.lit(name).alias("name"), "removed") for name, df in sorted(tables.items())]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return left, out
