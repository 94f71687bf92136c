"""Structural findings, scoped detection, enrichment, clusters and their annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions import scores as S
from graphweave.functions.text import strip
from graphweave.operators import graph as G
from graphweave.plans.tables import discard, joined, materialise, written


def provenance(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Nodes and relationships whose schema version is blank. A null one reads as the text of a null, which isn't."""
    blank = strip(F.col("schema_version")) == ""
    pick = lambda df, what: df.where(blank).select("dedupe_key", F.lit(f"missing_provenance_{what}").alias("method"), F.lit("critical").alias("severity"))
    return pick(nodes, "node").unionByName(pick(rels, "rel"))


def qualifier_missing(nodes: DataFrame, qualifiers: dict[str, str]) -> DataFrame:
    """Nodes whose type has a qualifier property that the node lacks, or holds blank."""
    # a schema has at most 50 node types, so this map is a literal
    name = F.create_map(*[F.lit(x) for kv in qualifiers.items() for x in kv])[F.col("node_type")]
    value = F.element_at("properties", name)
    lacks = name.isNotNull() & (strip(F.coalesce(value, F.lit(""))) == "")
    return nodes.where(lacks).select("dedupe_key", F.lit("qualifier_missing").alias("method"), F.lit("medium").alias("severity"))


def structural(nodes: DataFrame, rels: DataFrame, qualifiers: dict[str, str]) -> DataFrame:
    """All structural findings but degree outliers: one row per finding."""
    alone = G.orphans(nodes, rels).select("dedupe_key", F.lit("orphan_node").alias("method"), F.lit("medium").alias("severity"))
    return alone.unionByName(provenance(nodes, rels)).unionByName(qualifier_missing(nodes, qualifiers))


def suppress_orphans(found: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Without the orphan findings of nodes that a duplicate finding names."""
    named = duplicates.select("dedupe_key").distinct().withColumn("method", F.lit("orphan_node"))
    return found.join(named, ["dedupe_key", "method"], "left_anti")


def touching(rels: DataFrame, focus: DataFrame) -> DataFrame:
    """Relationships with an end in the focus (column dedupe_key)."""
    keys = focus.select("dedupe_key").distinct()
    for end in ("start", "end"):
        rels = rels.join(keys.select(F.col("dedupe_key").alias(f"{end}_dedupe_key"), F.lit(True).alias(f"__{end}")), f"{end}_dedupe_key", "left")
    return rels.where("__start or __end").drop("__start", "__end")


def scoped_detection(nodes: DataFrame, rels: DataFrame, schema: DataFrame, focus: DataFrame) -> DataFrame:
    """Duplicates, violations and orphans that concern the focus: method and key, each once; an orphan that is
    a duplicate too is left out."""
    keys = focus.select("dedupe_key").distinct()
    mine, near = nodes.join(keys, "dedupe_key", "left_semi"), touching(rels, focus)
    pick = lambda df, method: df.select("dedupe_key", F.lit(method).alias("method"))
    doubled = pick(G.exact_node_duplicates(mine), "exact_node_dedupe_key")
    orphan = pick(G.orphans(mine, rels), "orphan_node")
    rest = [pick(G.exact_rel_duplicates(near), "exact_rel_dedupe_key"), pick(G.canonical_violations(near, nodes, schema), "canonical_violation")]
    found = doubled.unionByName(suppress_orphans(orphan, doubled))
    for df in rest:
        found = found.unionByName(df)
    return found.distinct()


def scoped_candidates(nodes: DataFrame, rels: DataFrame, schema: DataFrame, focus: DataFrame, properties: DataFrame, qualifiers: dict[str, str]) -> DataFrame:
    """Findings of all detectors that concern the focus: dedupe_key, other, method, each once.

    Beside those of scoped_detection: probable duplicates that the window finds (key_a, key_b) and bidirectional
    duplicates (all keys in dedupe_key), with an end in the focus; missing provenance and qualifiers of its nodes, read from
    `properties`. Orphans that are duplicates of either kind are left out.
    """
    keys = focus.select("dedupe_key").distinct()
    mine, near = nodes.join(keys, "dedupe_key", "left_semi"), touching(rels, focus)
    pick = lambda df, method, key="dedupe_key": df.select(F.col(key).alias("dedupe_key"), F.lit(None).cast("string").alias("other"), F.lit(method).alias("method"))
    window = G.probable_pairs(nodes, rels, focus=focus)
    alike = materialise(window.select(F.col("key_a").alias("start_dedupe_key"), F.col("key_b").alias("end_dedupe_key")), "alike")
    doubled = G.exact_node_duplicates(mine)
    named = doubled.select("dedupe_key").unionByName(alike.select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("dedupe_key")))
    found = structural(properties, rels, qualifiers).join(keys, "dedupe_key", "left_semi")
    found = suppress_orphans(found, named).select("dedupe_key", F.lit(None).cast("string").alias("other"), "method")
    for df in (
        pick(doubled, "exact_node_dedupe_key"),
        alike.select(F.col("start_dedupe_key").alias("dedupe_key"), F.col("end_dedupe_key").alias("other"), F.lit("probable_duplicate").alias("method")),
        pick(G.exact_rel_duplicates(near), "exact_rel_dedupe_key"),
        pick(G.bidirectional_duplicates(near), "bidirectional_rel_duplicate", "refs"),
        pick(G.canonical_violations(near, nodes, schema), "canonical_violation"),
    ):
        found = found.unionByName(df)
    return found.distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """dedupe_key, root: the least key that pairs (key_a, key_b) reach.

    Keys get numbers in no order of theirs. Each round a number goes to the least among itself and its neighbours, twice over, and
    the pairs are those of where their ends went: long chains shrink by a factor, and a round costs what is left. The rounds' tables
    lie in the shared folder; the driver sees whether pairs are left. Keys that take part in no pair are not returned.
    """
    ends = materialise(pairs.where("key_a is not null and key_b is not null").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct(), "ends")
    keys = ends.select(F.explode(F.array("a", "b")).alias("k")).distinct().sortWithinPartitions(F.xxhash64("k"))
    keys = materialise(keys.select("k", F.monotonically_increasing_id().alias("n")), "keys")

    def moved(edges: DataFrame, to: DataFrame) -> DataFrame:
        for end in "ab":
            edges = edges.join(to.select(F.col(to.columns[0]).alias(end), F.col(to.columns[1]).alias(f"__{end}")).hint("merge"), end).drop(end)
        return edges.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))

    edges, path = written(moved(ends, keys), "edges")
    went: list[DataFrame] = []
    for _ in range(rounds):
        each = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(each.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "to")
        for _ in range(2):
            to = to.join(to.select(F.col("n").alias("to"), F.col("to").alias("far")).hint("merge"), "to").select("n", F.col("far").alias("to"))
            to = materialise(to, "to")
        went.append(to)
        before = path
        edges, path = written(moved(edges, to).where("a <> b").distinct(), "edges")
        discard(edges.sparkSession, [before])
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    last = went.pop()
    for to in reversed(went):
        far = last.select(F.col("n").alias("to"), F.col("to").alias("far")).hint("merge")
        last = to.join(far, "to", "left").select("n", F.coalesce("far", "to").alias("to"))
    label = materialise(keys.join(last.hint("merge"), "n").select(F.col("k").alias("dedupe_key"), "to"), "label")
    least = materialise(label.groupBy("to").agg(F.min("dedupe_key").alias("root"), F.count("*").alias("__n")), "least")
    return joined(label, least, "to").select("dedupe_key", "root")


def enrich(pairs: DataFrame, properties: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b, similarity, overlap, context, contained) with composite, conflicts and band.

    properties has dedupe_key and a map; a key without one counts as having none. The keys of a pair must be
    unique in properties.
    """
    side = lambda k: properties.select(F.col("dedupe_key").alias(f"key_{k}"), F.col("properties").alias(f"__{k}"))
    both = pairs.join(side("a"), "key_a", "left").join(side("b"), "key_b", "left")
    a, b = (F.coalesce(F.col(f"__{k}"), F.create_map().cast("map<string,string>")) for k in "ab")
    scored = both.withColumns({"property_overlap": F.round(S.property_overlap(a, b), 6), "conflicts": S.contradictions(a, b)})
    columns = [F.col(c) for c in ("similarity", "overlap", "context", "contained", "property_overlap")]
    return scored.withColumn("composite", S.composite(*columns)).withColumn("band", S.band(F.col("composite"), F.col("conflicts"))).drop("__a", "__b")


def validate_clusters(enriched: DataFrame, most: int = 8) -> DataFrame:
    """Enriched pairs with their cluster (least key) and whether it is suspect: of more than `most` keys, of mixed
    types, or with a conflict. A suspect cluster's high pairs become medium."""
    pairs = materialise(enriched, "pairs")
    roots = materialise(components(pairs), "roots")
    size = roots.groupBy("root").agg(F.count("*").alias("keys"))
    placed = pairs.join(roots.withColumnsRenamed({"dedupe_key": "key_a", "root": "cluster"}).hint("merge"), "key_a")
    facts = placed.groupBy("cluster").agg((F.min("node_type") != F.max("node_type")).alias("mixed"), F.max(F.size("conflicts") > 0).alias("conflict"), F.count("*").alias("__n"))
    facts = facts.join(size.withColumnRenamed("root", "cluster"), "cluster")
    suspect = (F.col("keys") > most) | F.col("mixed") | F.col("conflict")
    facts = materialise(facts.select("cluster", "keys", suspect.alias("suspect"), "__n"), "facts")
    flagged = joined(materialise(placed, "placed"), facts, "cluster")
    return flagged.withColumn("band", F.when(F.col("suspect") & (F.col("band") == "high"), "medium").otherwise(F.col("band")))


def other_partners(pairs: DataFrame, most: int = 10) -> DataFrame:
    """Per end of each pair (key_a, key_b, value_a, value_b): how many values its other partners have in all pairs, and
    the first `most` of them in order. Partners of equal value count once.

    A hub's partners are never one row: values are counted with a combine, and only the first most + 1 of an end
    are gathered, which leaves enough after the values that only the pair's own partner has are gone.
    """
    side = lambda k, p: F.struct(F.col(f"key_{k}").alias("k"), F.col(f"key_{p}").alias("p"), F.col(f"value_{p}").alias("v"))
    ends = pairs.select("key_a", "key_b", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e"))
    ends = ends.select("key_a", "key_b", F.col("e.k").alias("dedupe_key"), F.col("e.p").alias("partner"), F.col("e.v").alias("value")).distinct()
    # a value goes from a pair's list where its partner alone has it
    values = ends.groupBy("dedupe_key", "value").agg(F.count_distinct("partner").alias("holders"))
    count = values.groupBy("dedupe_key").agg(F.count("*").alias("n"))
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("value"))).where(F.col("r") <= most + 1)
    first = first.groupBy("dedupe_key").agg(F.array_sort(F.collect_list("value")).alias("first"))
    own = ends.join(values, ["dedupe_key", "value"]).withColumn("alone", F.col("holders") == 1)
    rest = F.when(F.col("alone"), F.array_except("first", F.array("value"))).otherwise(F.col("first"))
    return own.join(count, "dedupe_key").join(first, "dedupe_key").select(
        "key_a", "key_b", "dedupe_key", (F.col("n") - F.col("alone").cast("int")).alias("others"), F.array_join(F.slice(rest, 1, most), ",").alias("first_others"))
