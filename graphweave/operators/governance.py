"""Proposals: transitions, approval, plans of steps, their effect on the graph, invariants and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.text import strip
from graphweave.plans.tables import heavy_keys, looked_up

# The moves between proposal states that are allowed.
TRANSITIONS = [
    ("pending", "approved"), ("pending", "rejected"), ("pending", "deferred"), ("pending", "excluded"),
    ("approved", "executed"), ("deferred", "pending"), ("excluded", "pending"),
]


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "state string, wanted string")


def move(requests: DataFrame, proposals: DataFrame) -> DataFrame:
    """Requests (proposal_id, wanted) with the proposal's state and outcome: moved, illegal or unknown."""
    allowed = transitions(requests.sparkSession).withColumn("ok", F.lit(True))
    both = requests.join(proposals.select("proposal_id", "state"), "proposal_id", "left").join(F.broadcast(allowed), ["state", "wanted"], "left")
    return both.select("proposal_id", "state", "wanted", F.when(F.col("state").isNull(), "unknown").when(F.col("ok"), "moved").otherwise("illegal").alias("outcome"))


# Classes of proposals that need a second confirmation.
HIGH_RISK = ["merge", "delete"]


def approve(proposals: DataFrame) -> DataFrame:
    """What an approval does to each proposal (proposal_id, state, proposal_class, override): none where approved already,
    conflict where the move is not allowed, token (a second confirmation) for a high-risk class or where the proposal
    says so itself, else approve."""
    risky = F.col("proposal_class").isin(HIGH_RISK) | F.coalesce("override", F.lit(False))
    outcome = F.when(F.col("state") == "approved", "none").when(F.coalesce("state", F.lit("")) != "pending", "conflict").when(risky, "token").otherwise("approve")
    return proposals.select("proposal_id", "state", "proposal_class", outcome.alias("outcome"))


def confirm(requests: DataFrame, tokens: DataFrame, hours: int = 1) -> DataFrame:
    """Requests (token, proposal_id, at) with whether a token of that proposal holds at that time: not more
    than `hours` old."""
    held = tokens.select("token", F.col("proposal_id").alias("__of"), F.col("issued_at").alias("__from"))
    late = F.col("at") >= F.col("__from") + F.make_interval(hours=F.lit(hours))
    return requests.join(held, "token", "left").select(
        "token", "proposal_id", F.when(F.col("__of").isNull(), "unknown").when(F.col("__of") != F.col("proposal_id"), "mismatch").when(late, "expired").otherwise("confirmed").alias("outcome"))


def plan_steps(targets: DataFrame, version: str = "v1") -> DataFrame:
    """proposal_id, step, operation, dedupe_key, merge_keys, rel_type, start_key, end_key: the ordered plan of each proposal.

    targets has proposal_id, proposal_class, pos, element_type (node or relationship), dedupe_key and, for relationships
    that get another type, new_type, start_key and end_key; rows of another element_type are left out. Renames
    and the like update each target in the order of keys. A normalisation with retyped relationships consists of
    those alone, in the order of pos: the old one is deleted and one with the new type and key created, if both
    ends are known. A merge of nodes is one step on the first with all keys in order; a merge of relationships alone
    deletes all but the first; a delete takes relationships before nodes; a deferral has no step. A
    proposal's targets are few.
    """
    known = targets.where(F.col("element_type").isin("node", "relationship"))
    row = F.struct("pos", "element_type", "dedupe_key", "new_type", "start_key", "end_key")
    got = known.groupBy("proposal_id", "proposal_class").agg(F.array_sort(F.collect_list(row)).alias("t"))
    none = F.lit(None).cast("string")

    def step(operation, key, keys=None, kind=none, start=none, end=none):  # noqa: ANN001, ANN202
        keys = F.lit(None).cast("array<string>") if keys is None else keys
        operation = F.lit(operation) if isinstance(operation, str) else operation
        return F.struct(operation.alias("operation"), key.alias("dedupe_key"), keys.alias("merge_keys"), kind.alias("rel_type"), start.alias("start_key"), end.alias("end_key"))

    nodes, edges = F.filter("t", lambda x: x.element_type == "node"), F.filter("t", lambda x: x.element_type == "relationship")
    keyed = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x.dedupe_key.alias("dedupe_key"), x.element_type.alias("element_type"))))
    deleted = lambda a: F.transform(keyed(a), lambda x: step(F.concat(F.lit("delete_"), F.when(x.element_type == "node", "node").otherwise("edge")), x.dedupe_key))
    update = F.transform(keyed(F.col("t")), lambda x: step(F.concat(F.lit("update_"), F.when(x.element_type == "node", "node").otherwise("edge")), x.dedupe_key))
    nothing = F.filter(update, lambda _: F.lit(False))
    retyped = F.filter(edges, lambda x: F.coalesce(x.new_type, F.lit("")) != "")
    ended = F.filter(retyped, lambda x: (F.coalesce(x.start_key, F.lit("")) != "") & (F.coalesce(x.end_key, F.lit("")) != ""))
    again = F.flatten(F.transform(ended, lambda x: F.array(
        step("delete_edge", x.dedupe_key),
        step("create_edge", F.concat_ws("::", x.new_type, x.start_key, x.end_key, F.lit(version)), None, x.new_type, x.start_key, x.end_key))))
    rest = F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1)))
    merge = (
        F.when(F.size(nodes) >= 2, F.array(step("merge_nodes", F.get(nodes, 0)["dedupe_key"], F.transform(nodes, lambda x: x.dedupe_key))))
        .when((F.size(nodes) == 0) & (F.size(edges) >= 2), F.transform(rest, lambda x: step("delete_edge", x.dedupe_key)))
        .otherwise(nothing)
    )
    kind = F.col("proposal_class")
    steps = (
        F.when((kind == "normalize") & (F.size(retyped) > 0), again).when(kind.isin("canonicalize", "rename", "normalize"), update)
        .when(kind == "merge", merge).when(kind == "delete", F.concat(deleted(edges), deleted(nodes))).otherwise(nothing)
    )
    return got.select("proposal_id", F.posexplode(steps).alias("step", "s")).select("proposal_id", F.col("step").cast("long").alias("step"), "s.*")


def delete_nodes(nodes: DataFrame, rels: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes left, and the relationships left: those of a deleted node go with it."""
    keys = gone.select("dedupe_key").distinct()
    for end in ("start_dedupe_key", "end_dedupe_key"):
        rels = rels.join(keys.withColumnRenamed("dedupe_key", end).hint("merge"), end, "left_anti")
    return nodes.join(keys.hint("merge"), "dedupe_key", "left_anti"), rels


def delete_edges(rels: DataFrame, gone: DataFrame) -> DataFrame:
    return rels.join(gone.select("dedupe_key").distinct().hint("merge"), "dedupe_key", "left_anti")


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the properties of changes (dedupe_key, put map, cut array; a key at most once) put over
    their own, and those in cut removed."""
    both = nodes.join(changes.select("dedupe_key", F.col("put").alias("__put"), F.col("cut").alias("__cut")).hint("merge"), "dedupe_key", "left")
    put, cut = F.coalesce("__put", F.create_map().cast("map<string,string>")), F.coalesce("__cut", F.array().cast("array<string>"))
    own = F.map_filter("properties", lambda k, _: ~F.array_contains(F.concat(F.map_keys(put), cut), k))
    kept = F.map_filter(put, lambda k, _: ~F.array_contains(cut, k))
    return both.withColumn("properties", F.map_concat(own, kept)).drop("__put", "__cut")


def collapse(rels: DataFrame, merges: DataFrame, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Relationships after the nodes in merges (obsolete, survivor, nth: the order) were merged, and the keys that this
    affects.

    Ends that are obsolete become their survivor; loops that this makes go, and so do loops of obsolete nodes and
    relationships between two of them. Of relationships with equal type and ends one stays: one that was there
    before, else that of the first obsolete node; it keeps its own properties without those that begin with _,
    its chunk and its run, and gets a new key. moved says that none was there before. A survivor must not be obsolete
    itself; obsolete keys are unique. Affected are survivors, obsolete nodes, and the other ends.
    """
    ends = ["start_dedupe_key", "end_dedupe_key"]
    # nodes with many relationships would send all of them to one task
    hubs = heavy_keys(rels.select(F.explode(F.array(*ends)).alias("key")), "key")
    for end, key in zip(("start", "end"), ends, strict=True):
        facts = merges.select(F.col("obsolete").alias(key), F.col("survivor").alias(f"__{end}"), F.col("nth").alias(f"__{end}_nth"))
        rels = looked_up(rels, facts, key, hubs.select(F.col("key").alias(key)), ends)
    start, end = F.coalesce("__start", "start_dedupe_key"), F.coalesce("__end", "end_dedupe_key")
    moved = F.col("__start").isNotNull() | F.col("__end").isNotNull()
    both = F.col("__start").isNotNull() & F.col("__end").isNotNull()
    nth = F.coalesce(F.least("__start_nth", "__end_nth"), F.lit(-1))
    kept = rels.withColumns({"__moved": moved, "__order": F.struct(nth, "dedupe_key"), "__a": start, "__b": end}).where(~moved | ((start != end) & ~both))
    own = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: ~F.startswith(k, F.lit("_")))
    first = F.min_by(F.struct("run_id", "chunk_id", "schema_version", F.when(moved, own).otherwise(F.col("properties")).alias("properties"), "dedupe_key"), "__order").alias("x")
    new = kept.groupBy("rel_type", F.col("__a").alias("start_dedupe_key"), F.col("__b").alias("end_dedupe_key")).agg(F.min("__moved").alias("moved"), first)
    key = F.concat_ws("::", "rel_type", "start_dedupe_key", "end_dedupe_key", F.lit(version))
    out = new.select("rel_type", "start_dedupe_key", "end_dedupe_key", "moved", "x.run_id", "x.chunk_id", "x.schema_version", "x.properties",
                     F.when(F.col("moved"), key).otherwise(F.col("x.dedupe_key")).alias("dedupe_key"))
    hit = rels.where(moved).select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("dedupe_key"))
    keys = merges.select(F.explode(F.array("obsolete", "survivor")).alias("dedupe_key"))
    return out, hit.unionByName(keys).distinct()


def invariants(nodes: DataFrame, rels: DataFrame, present: DataFrame, absent: DataFrame) -> DataFrame:
    """Names and counts of what a new snapshot breaks: keys that must be there, keys that must not, and
    ends without a node. All counts are 0 before a snapshot takes the old one's place."""
    keys = nodes.select("dedupe_key").distinct()
    ends = rels.select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("dedupe_key")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("name"), "broken")
    return (
        count(present.join(keys, "dedupe_key", "left_anti"), "missing")
        .unionByName(count(absent.join(keys, "dedupe_key", "left_semi"), "left over"))
        .unionByName(count(ends.join(keys, "dedupe_key", "left_anti"), "dangling end"))
    )


def append_once(log: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of new that the log lacks, and those that are in conflict with a row of it: an append-only log
    (audit, proposals, exclusions) takes the first only."""
    have = log.select(key).distinct()
    return new.join(have, key, "left_anti"), new.join(have, key, "left_semi")


def archive(proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The proposals that stay (executed ones), those that go to the archive, and its manifest: archived ids in order
    with their number, per run."""
    kept, gone = proposals.where("state = 'executed'"), proposals.where("state <> 'executed' or state is null")
    return kept, gone, gone.groupBy("run_id").agg(F.count("*").alias("archived"), F.min("proposal_id").alias("first_id"), F.max("proposal_id").alias("last_id"))


# The classes that a node type may have.
NODE_CLASSES = ["Entity", "Event", "Concept", "Document", "Location", "Asset", "Metric", "Role"]


def schema_issues(types: DataFrame, edges: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """Rule and subject of each breach in a proposed schema: types (type, node_class, primary_property) and edges
    (type, start_node_type, end_node_type). Where locked has a row, that is the only breach; blank fields of types and
    edges are breaches where there is no other."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    pick = lambda df, rule, subject="type": df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    size = lambda df, rule, most: pick(df.agg(F.count("*").alias("type")).where(~F.col("type").between(1, most)), rule)
    undefined = lambda end: pick(edges.join(types.select(F.col("type").alias(end)).distinct(), end, "left_anti"), f"undefined_{end}", end)
    ends = edges.select(F.explode(F.array("start_node_type", "end_node_type")).alias("type")).distinct()
    repeat = F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("nth")
    issues = [
        size(types, "node_count", 50), size(edges, "edge_count", 100),
        pick(types.groupBy("type").agg(F.count("*").alias("n")).where("n > 1").select("type", repeat), "duplicate_type"),
        pick(types.where(~F.coalesce("node_class", F.lit("")).isin(NODE_CLASSES)), "node_class"),
        pick(types.where(~F.coalesce("type", F.lit("")).rlike(r"^\p{Lu}[^_]*$")), "pascal_case"),
        pick(edges.where(~F.coalesce("type", F.lit("")).rlike(r"^(?=.*\p{L})[\p{L}_]+$") | (F.upper("type") != F.col("type"))), "screaming_snake_case"),
        undefined("start_node_type"), undefined("end_node_type"),
        pick(types.select("type").distinct().join(ends, "type", "left_anti"), "orphan_type"),
        pick(types.where((F.lower("primary_property") != F.col("primary_property")) | F.contains("primary_property", F.lit(" "))), "snake_case"),
    ]
    found = reduce(DataFrame.unionByName, issues)
    fields = pick(types.where(blank(F.col("type")) | blank(F.col("primary_property"))), "blank_field")
    # blank fields count only where nothing else was found: one row says so
    any_ = found.agg((F.count("*") > 0).alias("any"))
    found = found.unionByName(fields.crossJoin(F.broadcast(any_.where("not any"))).drop("any"))
    if locked is None:
        return found
    held = locked.agg(F.max("version_hash").alias("version_hash"))
    return found.crossJoin(F.broadcast(held.where("version_hash is null"))).drop("version_hash").unionByName(
        held.where("version_hash is not null").select(F.lit("locked").alias("rule"), F.col("version_hash").alias("subject")))
