"""Findings of all detectors as one table, and their way to proposals: groups, clusters, targets."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.functions import scores as S
from graphweave.functions.text import candidate_id
from graphweave.operators import curation as C
from graphweave.operators import graph as G
from graphweave.plans.tables import materialise

FINDING = ["candidate_id", "candidate_type", "lane", "severity", "method", "refs", "stage"]


def finding(df: DataFrame, kind: str, method, severity, refs, stage: int) -> DataFrame:  # noqa: ANN001
    """The columns of FINDING; the id is the hash of run, version, type, sorted references and method."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    ident = F.col("candidate_id") if "candidate_id" in df.columns else candidate_id(kind, refs, method)
    return df.select(
        ident.alias("candidate_id"), F.lit(kind).alias("candidate_type"), G.lane(F.lit(kind)).alias("lane"), lit(severity).alias("severity"),
        lit(method).alias("method"), refs.alias("refs"), F.lit(stage).alias("stage"))


def structural_findings(nodes: DataFrame, rels: DataFrame, properties: DataFrame, qualifiers: dict[str, str], run: str, version: str) -> DataFrame:
    """The structural findings as candidates of a run, which stamps them: what they miss may be their own version."""
    rows = C.structural(properties, rels, qualifiers).withColumns({"run_id": F.lit(run), "schema_version": F.lit(version)})
    kinds = ("orphan_node", "missing_provenance_node", "missing_provenance_rel", "qualifier_missing")
    of = lambda m: finding(rows.where(F.col("method") == m), "structural_anomaly", m, F.col("severity"), F.array("dedupe_key"), 3)
    return reduce(DataFrame.unionByName, map(of, kinds))


def generate(
    nodes: DataFrame, rels: DataFrame, schema: DataFrame, amendments: DataFrame | None, properties: DataFrame, qualifiers: dict[str, str],
    run: str, version: str, stage: int | None = None, types: list[str] | None = None,
) -> DataFrame:
    """The findings of a run: of stage 1 (exact duplicates and violations), 2 (probable duplicates), 3 (structure) or all.

    An orphan that an exact or probable duplicate names is left out; a candidate that comes twice stays once, the
    first by stage.
    """
    found: list[DataFrame] = []
    if stage in (None, 1):
        exact, bad = G.exact_rel_duplicates(rels), G.canonical_violations(rels, nodes, schema, amendments)
        found += [
            finding(G.exact_node_duplicates(nodes), "exact_node_duplicate", "exact_node_dedupe_key", "high", F.array("dedupe_key"), 1),
            finding(exact, "exact_rel_duplicate", "exact_rel_dedupe_key", "high", F.array("dedupe_key"), 1),
            finding(G.bidirectional_duplicates(rels), "exact_rel_duplicate", "bidirectional_rel_duplicate", "high", F.split("refs", " "), 1),
            finding(bad, "canonical_violation", F.concat(F.lit("canonical_"), "violation", F.lit("_violation")), F.col("severity"), F.array("dedupe_key", "start_dedupe_key", "end_dedupe_key"), 1),
        ]
    if stage in (None, 2):
        found.append(finding(G.probable_pairs(nodes, rels, types), "probable_duplicate", F.col("method"), F.col("severity"), F.array("key_a", "key_b"), 2))
    if stage in (None, 3):
        found.append(structural_findings(nodes, rels, properties, qualifiers, run, version))
    every = materialise(reduce(DataFrame.unionByName, found), "found")
    named = every.where(F.col("candidate_type").isin("exact_node_duplicate", "probable_duplicate")).select(F.explode("refs").alias("__ref")).distinct()
    # only orphans are looked up: a join of all findings would bring those without a key to one task
    orphan = F.col("method") == "orphan_node"
    alone = every.where(orphan).withColumn("__ref", F.get("refs", 0)).join(named, "__ref", "left_anti").drop("__ref")
    return first_by_id(every.where(~orphan).unionByName(alone))


def first_by_id(found: DataFrame) -> DataFrame:
    """One row per candidate_id, the first by stage; what comes without a stage is before all."""
    order = F.struct(F.coalesce("stage", F.lit(0)), F.sort_array("refs"))
    return found.groupBy("candidate_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "candidate_id"]), order).alias("x")).select("candidate_id", "x.*")


def recommend(found: DataFrame) -> DataFrame:
    """action and confidence beside findings with their scores (value_a, value_b, similarity, overlap, context, contained)."""
    act, sure = S.advice(*[F.col(c) for c in ("candidate_type", "method", "value_a", "value_b", "similarity", "overlap", "context", "contained")])
    return found.withColumns({"action": act, "confidence": sure})


def shared_groups(found: DataFrame) -> DataFrame:
    """candidate_id, group: candidates (candidate_id, refs) that are connected by shared references have one group, the
    least candidate_id of them."""
    each = found.select("candidate_id", F.explode("refs").alias("ref")).distinct()
    # sides that grow with the findings are merged, as small ones on disk are large broadcasts
    link = each.groupBy("ref").agg(F.min("candidate_id").alias("least")).hint("merge").join(each, "ref").where("candidate_id <> least")
    roots = C.components(link.select(F.col("least").alias("key_a"), F.col("candidate_id").alias("key_b")))
    rows = found.select("candidate_id").join(roots.select(F.col("dedupe_key").alias("candidate_id"), "root").hint("merge"), "candidate_id", "left")
    return rows.select("candidate_id", F.coalesce("root", "candidate_id").alias("group"))


def packed_batches(found: DataFrame, size: int = 8) -> DataFrame:
    """candidate_id, call, batch: the candidates of each call (columns call, seq, candidate_id, refs), of which a caller
    sends at most some hundreds, packed in the order of their groups' first seq: groups stay whole, a group that
    doesn't fit begins a new batch, and one larger than a batch is one by itself."""
    groups = shared_groups(found)
    rows = found.select("call", "seq", "candidate_id").join(groups.hint("merge"), "candidate_id")
    sizes = rows.groupBy("call", "group").agg(F.min("seq").alias("first"), F.count("*").alias("n"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        batch, room, out = -1, 0, []
        for n in part.sort_values("first")["n"]:
            if n > size:
                batch, room = batch + 1, 0
            elif n > room:
                batch, room = batch + 1, size - n
            else:
                room -= n
            out.append(batch)
        return part.sort_values("first").assign(batch=out)[["call", "group", "batch"]]

    placed = sizes.groupBy("call").applyInPandas(pack, "call long, group string, batch long")
    return rows.join(placed.hint("merge"), ["call", "group"]).select("candidate_id", "call", "batch")


def consolidated(found: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that share references as one each, and candidate_id, cluster_id: what became of every candidate.

    found: candidate_id, seq, run_id, schema_version, refs; reports: candidate_id, score, items (array). A single
    candidate passes as it is. Others become a cluster_merge of all their references in order, the survivor (the
    least) first, with the items of all and the best score.
    """
    rows = found.join(shared_groups(found), "candidate_id").join(reports, "candidate_id", "left")
    parts = rows.groupBy("group").agg(
        F.count("*").alias("n"), F.min_by("candidate_id", "seq").alias("single"), F.min_by("run_id", "seq").alias("run_id"), F.min_by("schema_version", "seq").alias("schema_version"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), F.min_by("refs", "seq").alias("own"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.flatten(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("items", F.array().cast("array<string>")).alias("items"))))["items"]).alias("items"))
    ident = F.when(F.col("n") == 1, F.col("single")).otherwise(candidate_id("probable_duplicate", F.col("refs"), "cluster_merge"))
    out = parts.withColumns({"cluster_id": ident, "refs": F.when(F.col("n") == 1, F.col("own")).otherwise(F.col("refs"))})
    return out.select("cluster_id", "n", "refs", "score", "items"), rows.select("candidate_id", "group").join(out.select("group", "cluster_id"), "group").select("candidate_id", "cluster_id")


def packet_targets(outputs: DataFrame, found: DataFrame) -> DataFrame:
    """candidate_id, proposal_class, pos, element_type, dedupe_key, new_type, start_key, end_key: what a proposal aims at.

    outputs: candidate_id, proposal_class, normalize_target. found: candidate_id, lane, method, refs, rel_key, rel_type,
    start_key, end_key. A normalisation of a violation without a target type keeps the type where the direction is
    inverse, and else is deferred. References are nodes but for the relationship itself, and all of a
    bidirectional duplicate; a retyped relationship carries its new type and ends, swapped where they were inverse.
    """
    rows = outputs.join(found, "candidate_id")
    violation = F.col("candidate_type") == "canonical_violation"
    inverse, none = F.col("method") == "canonical_inverse_violation", F.lit(None).cast("string")
    lacks = (F.col("proposal_class") == "normalize") & violation & (F.coalesce("normalize_target", F.lit("")) == "")
    target = F.when(lacks & inverse, F.col("rel_type")).otherwise(F.col("normalize_target"))
    kind = F.when(lacks & ~inverse, "defer").otherwise(F.col("proposal_class"))
    rows = rows.withColumns({"__target": target, "__class": kind, "__both": F.col("method") == "bidirectional_rel_duplicate"}).select("*", F.posexplode("refs").alias("pos", "ref"))
    edge = (F.col("lane") == "relationship") & (F.col("__both") | (F.col("ref") == F.col("rel_key")))
    again = edge & ~F.col("__both") & (F.col("__class") == "normalize") & (F.coalesce("__target", F.lit("")) != "")
    swap = lambda a, b: F.when(again, F.when(inverse, F.col(b)).otherwise(F.col(a))).otherwise(none)
    return rows.select(
        "candidate_id", F.col("__class").alias("proposal_class"), "pos", F.when(edge, "relationship").otherwise("node").alias("element_type"), F.col("ref").alias("dedupe_key"),
        F.when(again, F.col("__target")).otherwise(none).alias("new_type"), swap("start_key", "end_key").alias("start_key"), swap("end_key", "start_key").alias("end_key"))


def open_candidates(found: DataFrame, excluded: DataFrame, proposals: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Findings that are not excluded, have no proposal but rejected ones and, where ids are requested, are among them."""
    left = found.join(excluded.select("candidate_id").distinct(), "candidate_id", "left_anti")
    busy = proposals.where("state <> 'rejected'").select("candidate_id").distinct()
    left = left.join(busy, "candidate_id", "left_anti")
    return left if requested is None else left.join(requested.select("candidate_id").distinct(), "candidate_id", "left_semi")


def orphan_plan(found: DataFrame, run: str, actor: str) -> DataFrame:
    """Proposal, approval and step of each orphan finding, once per candidate: candidate_id, proposal_id, approval_id,
    operation, dedupe_key. write.applied takes the steps in one set."""
    mine = first_by_id(found.where("method = 'orphan_node'"))
    ident = F.sha2(F.to_json(F.struct("candidate_id", F.lit("delete").alias("proposal_class"), F.lit(run).alias("run_id"))), 256)
    rows = mine.withColumn("proposal_id", ident).withColumn("approval_id", F.sha2(F.concat(F.lit("approval:"), "proposal_id", F.lit(f":{actor}")), 256))
    return rows.select("candidate_id", "proposal_id", "approval_id", F.lit("delete_node").alias("operation"), F.explode("refs").alias("dedupe_key"))
