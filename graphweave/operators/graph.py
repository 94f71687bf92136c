"""Reads, explorer aggregates, detectors and the merge over the nodes and rels of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.functions.text import candidate_id, contained, content_tokens, jaccard, jaro_winkler, primary_value, token_containment, token_overlap, tokens
from graphweave.plans.tables import materialise, ranged


def degree(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """In and out counts of every distinct node, zeros included; a loop counts in both."""
    distinct = rels.select("dedupe_key", "start_dedupe_key", "end_dedupe_key").distinct()
    ends = distinct.select(F.col("start_dedupe_key").alias("dedupe_key"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        distinct.select(F.col("end_dedupe_key").alias("dedupe_key"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("dedupe_key").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("dedupe_key").distinct().join(sums, "dedupe_key", "left").select(
        "dedupe_key", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def degree_outliers(degrees: DataFrame) -> DataFrame:
    """Nodes whose total lies over the mean by more than three population deviations; none under 3 nodes."""
    total = degrees.withColumn("total", F.col("in_degree") + F.col("out_degree"))
    stats = total.agg(F.avg("total").alias("m"), F.stddev_pop("total").alias("s"), F.count("*").alias("n")).first()
    if stats["n"] < 3 or not stats["s"]:
        return total.where("false").select("dedupe_key", "total")
    return total.where(F.col("total") > stats["m"] + 3 * stats["s"]).select("dedupe_key", "total")


def orphans(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    ends = rels.select(F.explode(F.array("start_dedupe_key", "end_dedupe_key")).alias("dedupe_key")).distinct()
    return nodes.select("dedupe_key").distinct().join(ends, "dedupe_key", "left_anti")


def neighbors(rels: DataFrame) -> DataFrame:
    """Undirected distinct neighbours."""
    both = rels.select(F.col("start_dedupe_key").alias("dedupe_key"), F.col("end_dedupe_key").alias("neighbor")).unionByName(
        rels.select(F.col("end_dedupe_key").alias("dedupe_key"), F.col("start_dedupe_key").alias("neighbor")))
    return both.distinct()


def exact_node_duplicates(nodes: DataFrame) -> DataFrame:
    """Keys that several extracted nodes of a type share."""
    found = nodes.groupBy("run_id", "schema_version", "node_type", "dedupe_key").agg(F.count("*").alias("duplicate_count")).where("duplicate_count >= 2")
    return found.select(
        candidate_id("exact_node_duplicate", F.array("dedupe_key"), "exact_node_dedupe_key").alias("candidate_id"),
        F.lit("exact_node_duplicate").alias("candidate_type"), F.lit("high").alias("severity"), "node_type", "dedupe_key", "duplicate_count")


def exact_rel_duplicates(rels: DataFrame) -> DataFrame:
    """Keys that several relationships of a type share, with the ends of the first of them."""
    first = lambda c: F.min(F.struct("start_dedupe_key", "end_dedupe_key"))[c].alias(c)
    found = rels.groupBy("run_id", "schema_version", "rel_type", "dedupe_key").agg(
        F.count("*").alias("duplicate_count"), first("start_dedupe_key"), first("end_dedupe_key")).where("duplicate_count >= 2")
    return found.select(
        candidate_id("exact_rel_duplicate", F.array("dedupe_key"), "exact_rel_dedupe_key").alias("candidate_id"), F.lit("exact_rel_duplicate").alias("candidate_type"),
        F.lit("high").alias("severity"), "rel_type", "dedupe_key", "duplicate_count", "start_dedupe_key", "end_dedupe_key")


def bidirectional_duplicates(rels: DataFrame) -> DataFrame:
    """Edges of one type between the same two nodes, whatever their direction, that are not exact duplicates."""
    exact = rels.groupBy("dedupe_key").count().where("count >= 2").select("dedupe_key")
    rest = rels.join(exact, "dedupe_key", "left_anti").where("start_dedupe_key <> end_dedupe_key")
    ends = [f("start_dedupe_key", "end_dedupe_key").alias(name) for f, name in ((F.least, "a"), (F.greatest, "b"))]
    found = rest.groupBy("run_id", "schema_version", "rel_type", *ends).agg(F.array_sort(F.collect_set("dedupe_key")).alias("refs"))
    found = found.where(F.size("refs") >= 2)
    return found.select(
        candidate_id("exact_rel_duplicate", F.col("refs"), "bidirectional_rel_duplicate").alias("candidate_id"),
        "rel_type", F.array_join("refs", " ").alias("refs"), F.size("refs").cast("long").alias("edges"))


def effective_edges(schema: DataFrame, amendments: DataFrame | None = None) -> DataFrame:
    """rel_type, start_type, end_type that are allowed: the schema's and those added since."""
    columns = ("rel_type", "start_type", "end_type")
    base = schema.select(*columns)
    return base if amendments is None else base.unionByName(amendments.select(*columns))


def canonical_violations(rels: DataFrame, nodes: DataFrame, schema: DataFrame, amendments: DataFrame | None = None) -> DataFrame:
    """Relationships that neither schema nor amendments allow: inverse (the mirror is allowed) is high, others medium.

    A key with several nodes has the type of the last; an end without a node has an empty type, so nothing allows it.
    refs are the relationship's key and its ends in order. Schemas are joined as they come: Spark broadcasts
    them by their size.
    """
    kinds = nodes.groupBy("dedupe_key").agg(F.max_by("node_type", "seq").alias("kind"))
    start, end = (kinds.select(F.col("dedupe_key").alias(f"{x}_dedupe_key"), F.col("kind").alias(f"{x}_type")) for x in ("start", "end"))
    typed = rels.join(start, "start_dedupe_key", "left").join(end, "end_dedupe_key", "left").fillna("", ["start_type", "end_type"])
    allowed = effective_edges(schema, amendments).distinct()
    bad = typed.join(allowed, ["rel_type", "start_type", "end_type"], "left_anti")
    mirror = allowed.select("rel_type", F.col("start_type").alias("end_type"), F.col("end_type").alias("start_type"), F.lit(True).alias("inverse"))
    method = lambda m: candidate_id("canonical_violation", F.array("dedupe_key", "start_dedupe_key", "end_dedupe_key"), f"canonical_{m}_violation")
    return bad.join(mirror, ["rel_type", "start_type", "end_type"], "left").select(
        F.when(F.col("inverse"), method("inverse")).otherwise(method("direction")).alias("candidate_id"),
        "dedupe_key", "rel_type", "start_dedupe_key", "end_dedupe_key", "start_type", "end_type",
        F.when(F.col("inverse"), "inverse").otherwise("direction").alias("violation"), F.when(F.col("inverse"), "high").otherwise("medium").alias("severity"))


def values_of(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """node_type, dedupe_key, value, copies: each key with the value of its last row; blank values take no part, nor
    do types that are not listed (types: those that have a primary property; None for all)."""
    rows = nodes if types is None else nodes.where(F.col("node_type").isin(types))
    value = F.max_by(primary_value(F.col("primary_value")), "seq").alias("value")
    return rows.groupBy("node_type", "dedupe_key").agg(value, F.count("*").alias("copies")).where("value <> ''")


def sorted_window_pairs(nodes: DataFrame, width: int = 4, ranges: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Distinct pairs of keys where, in the order of value and key, a row is among the next `width` of the other.

    Rows that repeat a key take places of their own, so such a key is paired with itself. Of a key only width + 1
    rows are sorted, as more of them change no pair. A type of any size is cut into ranges, each sorted by a
    task of its own. What follows a range's last row are the first `width` rows of the ranges after it; a
    window over those alone (width rows per range and type) hands each range its successors.
    """
    rows = values_of(nodes, types).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(width + 1)).cast("int"))))
    rows = ranged(rows.drop("copies"), "node_type", "value", "dedupe_key", "copy", ranges=ranges).withColumn("x", F.struct("dedupe_key", "value"))
    order = Window.partitionBy("node_type", "__range").orderBy("value", "dedupe_key", "copy")
    leads = lambda w: F.array_compact(F.array(*[F.lead("x", i).over(w) for i in range(1, width + 1)]))
    heads = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= width)
    heads = heads.withColumn("after", leads(Window.partitionBy("node_type").orderBy("__range", "r")))
    after = heads.groupBy("node_type", "__range").agg(F.max_by("after", "r").alias("after"))
    full = rows.withColumn("ahead", leads(order)).join(after, ["node_type", "__range"], "left")
    pairs = full.withColumn("b", F.explode(F.slice(F.concat("ahead", "after"), 1, width)))
    flip = F.col("dedupe_key") > F.col("b.dedupe_key")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return pairs.select("node_type", pick("dedupe_key", "b.dedupe_key").alias("key_a"), pick("b.dedupe_key", "dedupe_key").alias("key_b"),
                        pick("value", "b.value").alias("value_a"), pick("b.value", "value").alias("value_b")).distinct()


#: Tokens of a value up to which all their pairs are looked under.
PAIRED_TOKENS = 32


def token_pairs(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Pairs of keys of a type where one value's content tokens contain the other's (see token_containment).

    The smaller set looks only under its two rarest tokens together, as all of its tokens must be in the larger: so what meets
    there shares both, and a two-word name meets those alone that hold it. Values of more than PAIRED_TOKENS tokens are looked
    up under single tokens in place of their many pairs.
    """
    rows = values_of(nodes, types).withColumn("t", F.array_sort(content_tokens(F.col("value"))))
    one = rows.select("node_type", F.explode("t").alias("token"), "dedupe_key", "value", "t")
    often = one.groupBy("node_type", "token").agg(F.count("*").alias("n"))
    rare = one.where(F.size("t") >= 2).join(often, ["node_type", "token"]).groupBy("node_type", "dedupe_key").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, 2).alias("two"), F.first("value").alias("v"), F.first("t").alias("s"))
    a = rare.select(
        "node_type", F.get("two.token", 0).alias("token"), F.least(F.get("two.token", 0), F.get("two.token", 1)).alias("p"), F.greatest(F.get("two.token", 0), F.get("two.token", 1)).alias("q"),
        F.col("dedupe_key").alias("a"), "v", "s")
    few = F.size("t") <= PAIRED_TOKENS
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("p"), y.alias("q")))))
    b = rows.select("node_type", F.col("dedupe_key").alias("b"), F.col("value").alias("w"), "t")
    short = b.where(few).withColumn("x", F.explode(pairs)).select("node_type", "x.p", "x.q", "b", "w", "t")
    long = one.where(~few).select("node_type", "token", F.col("dedupe_key").alias("b"), F.col("value").alias("w"), "t")
    both = a.join(short, ["node_type", "p", "q"]).drop("token").unionByName(a.join(long, ["node_type", "token"]).drop("token"))
    met = both.where((F.size("s") < F.size("t")) & contained(F.col("v"), F.col("w"), F.col("s"), F.col("t")))
    flip = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return met.select("node_type", pick("a", "b").alias("key_a"), pick("b", "a").alias("key_b"), pick("v", "w").alias("value_a"), pick("w", "v").alias("value_b"))


def context_jaccard(pairs: DataFrame, rels: DataFrame) -> DataFrame:
    """The pairs with the Jaccard of their neighbours, 0 without any: counted by joins, so that a hub's
    neighbours are never one row."""
    near = neighbors(rels)
    count = near.groupBy("dedupe_key").agg(F.count("*").alias("n"))
    side = lambda k: count.select(F.col("dedupe_key").alias(f"key_{k}"), F.col("n").alias(f"n_{k}"))
    of = lambda k: near.select(F.col("dedupe_key").alias(f"key_{k}"), "neighbor")
    both = pairs.select("key_a", "key_b").join(of("a"), "key_a").join(of("b"), ["key_b", "neighbor"]).groupBy("key_a", "key_b").agg(F.count("*").alias("i"))
    full = pairs.join(side("a"), "key_a", "left").join(side("b"), "key_b", "left").join(both, ["key_a", "key_b"], "left").fillna(0, ["n_a", "n_b", "i"])
    total = F.col("n_a") + F.col("n_b") - F.col("i")
    return full.withColumn("context", F.when(total == 0, 0.0).otherwise(F.round(F.col("i") / total, 6))).drop("n_a", "n_b", "i")


# How a probable duplicate was found.
BY_SIMILARITY, BY_TOKENS = "jaro_winkler_0.90", "token_containment"


def probable_duplicates(nodes: DataFrame, rels: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The pairs of probable_pairs without whether one's tokens contain the other's."""
    return probable_pairs(nodes, rels, types).drop("contained")


def probable_pairs(nodes: DataFrame, rels: DataFrame, types: list[str] | None = None, focus: DataFrame | None = None) -> DataFrame:
    """Pairs of a type that are near in sorted order and alike (Jaro-Winkler of 0.9 with token overlap of 0.5,
    or 0.95; else token containment), and pairs that token_pairs finds and the window has not compared; each
    once, with its candidate_id and severity. Scores are compared as they are and returned rounded.

    focus (dedupe_key): only pairs of the window with an end in it, and no others.
    """
    a, b = F.col("value_a"), F.col("value_b")
    shared = lambda df: df.withColumn("overlap", token_overlap(tokens(a), tokens(b)))
    near = sorted_window_pairs(nodes, types=types)
    if focus is None:
        near = materialise(shared(near), "window")  # tokens are split once: a filter above would split them again
        found = shared(token_pairs(nodes, types).join(near.select("node_type", "key_a", "key_b"), ["node_type", "key_a", "key_b"], "left_anti"))
        both = near.withColumn("window", F.lit(True)).unionByName(found.withColumn("window", F.lit(False)))
    else:
        keys = focus.select("dedupe_key").distinct()
        for end in "ab":
            near = near.join(keys.select(F.col("dedupe_key").alias(f"key_{end}"), F.lit(True).alias(f"__{end}")), f"key_{end}", "left")
        both = shared(near.where("__a or __b").drop("__a", "__b")).withColumn("window", F.lit(True))
    scored = both.withColumn("similarity", jaro_winkler("value_a", "value_b"))
    alike = F.col("window") & (F.col("similarity") >= 0.9) & ((F.col("similarity") >= 0.95) | (F.col("overlap") >= 0.5))
    # what token_pairs found is contained; branches of when are not worked out ahead, as both sides of & are
    held = F.when(alike, False).when(~F.col("window"), True).otherwise(token_containment(a, b))
    kept = scored.withColumns({"alike": alike, "contained": held}).where("alike or contained").withColumns({c: F.round(c, 6) for c in ("similarity", "overlap")})
    kept = materialise(kept, "kept")  # the context reads it twice, and scores are to be made once
    # the ids come from the nodes' own run and version, which all nodes of a run share
    stamp = nodes.groupBy("dedupe_key").agg(F.max_by("run_id", "seq").alias("run_id"), F.max_by("schema_version", "seq").alias("schema_version"))
    named = context_jaccard(kept, rels).join(stamp.withColumnRenamed("dedupe_key", "key_a"), "key_a")
    refs = F.array("key_a", "key_b")
    named = named.withColumn("candidate_id", F.when(F.col("alike"), candidate_id("probable_duplicate", refs, BY_SIMILARITY)).otherwise(candidate_id("probable_duplicate", refs, BY_TOKENS)))
    return named.select(
        "candidate_id", "node_type", "key_a", "key_b", "value_a", "value_b", F.when(F.col("alike"), BY_SIMILARITY).otherwise(BY_TOKENS).alias("method"),
        F.lit("medium").alias("severity"), "similarity", "overlap", "context", "contained")


def window_scores(nodes: DataFrame) -> DataFrame:
    """Token overlap, Jaccard and containment of the window pairs."""
    pairs = sorted_window_pairs(nodes)
    a, b = tokens(F.col("value_a")), tokens(F.col("value_b"))
    return pairs.select("node_type", "key_a", "key_b", F.round(token_overlap(a, b), 6).alias("token_overlap"), F.round(jaccard(a, b), 6).alias("jaccard"),
                        token_containment(F.col("value_a"), F.col("value_b")).alias("containment"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """MERGE by key: the first row's properties stay, the last row's run stamps; and how many matched."""
    return nodes.groupBy("dedupe_key").agg(
        F.min_by("primary_value", "seq").alias("primary_value"), F.min("seq").alias("created_seq"),
        F.max("seq").alias("last_seen_seq"), (F.count("*") - 1).alias("matched"))


def merge_edges(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist, merged by type and ends; counts of created, matched and skipped."""
    keys = nodes.select("dedupe_key").distinct()
    for end in ("start", "end"):
        rels = rels.join(keys.select(F.col("dedupe_key").alias(f"{end}_dedupe_key"), F.lit(1).alias(f"{end}_ok")), f"{end}_dedupe_key", "left")
    seen = rels.groupBy("rel_type", "start_dedupe_key", "end_dedupe_key", (F.col("start_ok").isNotNull() & F.col("end_ok").isNotNull()).alias("ok")).count()
    total = lambda ok, n, name: F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias(name)
    ok, n = F.col("ok"), F.col("count")
    return seen.agg(F.count_if("ok").alias("created"), total(ok, n - 1, "matched"), total(~ok, n, "skipped"))


# Severities from the gravest, and types of findings in their order.
SEVERITIES = ["critical", "high", "medium", "low"]
TYPES = ["exact_node_duplicate", "exact_rel_duplicate", "probable_duplicate", "canonical_violation", "structural_anomaly"]
# The lane of each type.
LANES = ["node", "relationship", "node", "relationship", "structural"]


def rank_in(value: Column, names: list[str]) -> Column:
    """Place in the list from 1; what is not in it comes last."""
    place = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(place > 0, place).otherwise(len(names) + 1)


def lane(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in zip(TYPES, LANES, strict=True) for x in kv]), kind)


def candidate_groups(found: DataFrame) -> DataFrame:
    """Per type, in the types' order: its lane, how many candidates by severity, and the first by severity and id.
    The members in order are candidate_members."""
    count = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    first = F.min_by("candidate_id", F.struct(rank_in(F.col("severity"), SEVERITIES), "candidate_id")).alias("first_id")
    groups = found.groupBy("candidate_type").agg(F.count("*").alias("total"), *count, first)
    return groups.withColumn("lane", lane(F.col("candidate_type"))).orderBy(rank_in(F.col("candidate_type"), TYPES))


def candidate_members(found: DataFrame) -> DataFrame:
    """Each candidate with its place in its type, by severity and id. A type of any size is cut into ranges, whose
    counts give each range's first place."""
    rows = ranged(found.withColumn("__s", rank_in(F.col("severity"), SEVERITIES)), "candidate_type", "__s", "candidate_id")
    sums = rows.groupBy("candidate_type", "__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("candidate_type").orderBy("__range")) - F.col("n")
    order = Window.partitionBy("candidate_type", "__range").orderBy("__s", "candidate_id")
    placed = rows.withColumn("nth", F.row_number().over(order)).join(sums.select("candidate_type", "__range", before.alias("before")), ["candidate_type", "__range"])
    return placed.withColumn("place", F.col("nth") + F.col("before")).drop("__s", "__range", "nth", "before")
