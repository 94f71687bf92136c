"""Curation, governance and chunking on small fixtures: clusters, nulls, empty tables, folds."""

import pytest
from pyspark.sql import functions as F

from graphweave.operators import chunking as K
from graphweave.operators import curation as C
from graphweave.operators import governance as V
from graphweave.operators import graph as G

NODES = "dedupe_key string, node_type string, schema_version string, properties map<string,string>"
RELS = "dedupe_key string, rel_type string, start_dedupe_key string, end_dedupe_key string, run_id string, schema_version string"


@pytest.mark.parametrize(("types", "sizes", "want"), [
    (["paragraph"] * 3, [400, 598, 1], [[0, 1], [2]]),
    (["paragraph", "heading", "paragraph", "heading"], [5, 5, 5, 5], [[0], [1, 2], [3]]),
    (["paragraph", "table", "paragraph"], [5, 5, 5], [[0], [1], [2]]),
    (["image", "caption", "caption", "footer", "paragraph"], [5, 5, 5, 5, 5], [[0, 1], [2, 4]]),
    (["image", "table", "heading", "paragraph"], [0, 0, 0, 0], []),
    (["paragraph"], [5000], [[0]]),
    ([], [], []),
])
def test_fold(types, sizes, want):
    assert K.fold(types, ["x" * n for n in sizes], 1000, 250) == want


def test_chunks(spark):
    rows = [(1, 0, "paragraph", "short", 2, 0.9), (1, 1, "paragraph", None, 3, 0.1), (2, 0, "header", "top", 1, None), (3, 0, "paragraph", "x" * 30, None, 0.69)]
    frame = spark.createDataFrame(rows, "doc_id long, pos long, element_type string, text string, page int, confidence double").withColumn("chars", F.lit(0))
    got = {r.doc_id: r for r in K.chunks(frame).collect()}
    assert (got[1].text, got[1].flags, got[1].start_page, got[1].error) == ("short", ["low_text_density"], 2, None)
    assert (got[2].chunk_index, got[2].error) == (None, "empty_document")
    assert (got[3].flags, got[3].start_page, got[3].error) == (["low_ocr_confidence"], None, "missing_page_info")
    assert K.chunks(frame.where("false")).count() == 0


def test_clusters(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("a", "b"), ("b", "a"), ("z", "z"), ("p", None), ("r", "q")]
    pairs = spark.createDataFrame(chain, "key_a string, key_b string")
    roots = {r.dedupe_key: r.root for r in C.components(pairs).collect()}
    assert roots == {f"n{i:02}": "n00" for i in range(21)} | {"a": "a", "b": "a", "z": "z", "r": "q", "q": "q"}
    assert C.components(pairs.where("false")).count() == 0


def test_validate_clusters(spark):
    rows = [(f"n{i}", f"n{i + 1}", "T", "high", []) for i in range(9)] + [("a", "b", "T", "high", []), ("c", "d", "T", "high", ["x"]), ("d", "e", "T", "low", []), ("g", "h", "T", "high", []), ("h", "i", "U", "high", [])]
    frame = spark.createDataFrame(rows, "key_a string, key_b string, node_type string, band string, conflicts array<string>")
    got = {r.key_a: (r.suspect, r.band) for r in C.validate_clusters(frame).collect()}
    assert got == {f"n{i}": (True, "medium") for i in range(9)} | {"a": (False, "high"), "c": (True, "medium"), "d": (True, "low"), "g": (True, "medium"), "h": (True, "medium")}


def test_cluster_query_takes_all_types(spark):
    from graphweave import registry

    d = "/root/testdata/sf0.001"
    ends = {(r.key_a, r.key_b) for r in registry.queries()["gr_cluster_validate"](spark, d).collect()}
    assert ends == {(r.key_a, r.key_b) for r in registry.queries()["gr_probable_dup"](spark, d).collect()}
    assert len({a.split("|")[0] for a, _ in ends}) > 1


def test_enrich(spark):
    pairs = spark.createDataFrame([("a", "b", 0.92, 0.5, 0.0, False), ("a", "c", 0.92, 0.5, 0.4, False), ("a", "b", 0.5, 0.5, 1.0, True), ("x", "y", 0.0, 0.0, 0.0, False)], "key_a string, key_b string, similarity double, overlap double, context double, contained boolean")
    props = spark.createDataFrame([("a", {"p": " 1", "q": "2", "run_id": "r"}), ("b", {"p": "1", "q": "3"}), ("c", None)], "dedupe_key string, properties map<string,string>")
    got = sorted((r.composite, r.property_overlap, r.conflicts, r.band) for r in C.enrich(pairs, props).collect())
    assert got == [(0.0, 0.0, [], "low"), (0.645, 0.0, [], "medium"), (0.773, 0.5, ["q"], "medium"), (0.9, 0.5, ["q"], "medium")]


def test_structural_and_scope(spark):
    nodes = spark.createDataFrame([("a", "T", None, None), ("b", "T", "v", {"q": " "}), ("c", "U", "v", {}), ("c", "U", "v", {}), ("d", "T", "v", {"q": "1"})], NODES)
    rels = spark.createDataFrame([("r", "R", "a", "d", "run1", "")], RELS)
    got = sorted((r.dedupe_key, r.method) for r in C.structural(nodes, rels, {"T": "q"}).collect())
    assert got == [("a", "qualifier_missing"), ("b", "orphan_node"), ("b", "qualifier_missing"), ("c", "orphan_node"), ("r", "missing_provenance_rel")]  # a null version is no blank one
    full = nodes.withColumns({"run_id": F.lit("run1"), "seq": F.lit(1)})
    schema = spark.createDataFrame([("T", "T", "R")], "start_type string, end_type string, rel_type string")
    focus = spark.createDataFrame([("c",), ("b",), (None,)], "dedupe_key string")
    assert sorted((r.dedupe_key, r.method) for r in C.scoped_detection(full, rels, schema, focus).collect()) == [("b", "orphan_node"), ("c", "exact_node_dedupe_key")]


def test_scoped_candidates(spark):
    """All detectors, for focus nodes only; an orphan that is a probable duplicate is no orphan finding."""
    rows = [("a", "red steel bolt", "v", {"q": "1"}), ("b", "red steel bolts", "v", {"q": "1"}), ("c", "omega", " ", {"q": " "}), ("d", "zulu", "v", {"q": "1"}), ("e", "yankee", "v", {}), ("f", "kilo one", "v", {"q": "1"}), ("g", "kilo ones", "v", {"q": "1"})]
    nodes = spark.createDataFrame([(k, "T", v, "run1", "v", i, s, p) for i, (k, v, s, p) in enumerate(rows)], "dedupe_key string, node_type string, primary_value string, run_id string, schema_version string, seq long, s string, properties map<string,string>")
    marked = nodes.select("dedupe_key", "node_type", "seq", F.col("s").alias("schema_version"), "properties")
    rels = spark.createDataFrame([("1", "R", "d", "e", "run1", "v"), ("2", "R", "e", "d", "run1", "v")], RELS)
    schema = spark.createDataFrame([("T", "T", "R")], "start_type string, end_type string, rel_type string")
    focus = spark.createDataFrame([("a",), ("c",), ("d",), (None,)], "dedupe_key string")
    got = sorted((r.dedupe_key, r.other or "", r.method) for r in C.scoped_candidates(nodes.drop("s", "properties"), rels, schema, focus, marked, {"T": "q"}).collect())
    assert got == [("1 2", "", "bidirectional_rel_duplicate"), ("a", "b", "probable_duplicate"), ("c", "", "missing_provenance_node"), ("c", "", "orphan_node"), ("c", "", "qualifier_missing")]


def test_merge_edges(spark):
    """Only edges with an end that is missing are skipped, whatever the type of the ends."""
    nodes = spark.createDataFrame([("n", "Nation", "v", None), ("r", "Region", "v", None)], NODES)
    rels = spark.createDataFrame([("1", "PART_OF", "n", "r", "", ""), ("1", "PART_OF", "n", "r", "", ""), ("2", "PART_OF", "n", "gone", "", ""), ("3", "R", None, "r", "", "")], RELS)
    assert tuple(G.merge_edges(rels, nodes).first()) == (1, 1, 2)
    assert tuple(G.merge_edges(rels, nodes.where("node_type <> 'Region'")).first()) == (0, 0, 4)


def test_collapse_and_update(spark):
    rows = [("1", "R", "a", "b"), ("2", "R", "o", "b"), ("3", "R", "o", "a"), ("4", "R", "x", "x"), ("5", "R", "c", "o"), ("6", "R", "o", "o"), ("7", "R", "o", "q"), ("8", "R", "c", "q"), ("9", "S", "o", "gone")]
    rels = spark.createDataFrame([(*r, "run1", "v1", f"chunk{r[0]}", {"p": r[0], "_k": "x"}) for r in rows], RELS + ", chunk_id string, properties map<string,string>")
    merges = spark.createDataFrame([("o", "a", 1), ("q", "a", 2)], "obsolete string, survivor string, nth int")
    new, keys = V.collapse(rels, merges)
    got = sorted((r.rel_type, r.start_dedupe_key, r.end_dedupe_key, r.moved, r.chunk_id, r.dedupe_key, r.properties["p"], "_k" in r.properties) for r in new.collect())
    assert got == [("R", "a", "b", False, "chunk1", "1", "1", True), ("R", "c", "a", True, "chunk5", "R::c::a::v1", "5", False), ("R", "x", "x", False, "chunk4", "4", "4", True), ("S", "a", "gone", True, "chunk9", "S::a::gone::v1", "9", False)]
    assert {r.dedupe_key for r in keys.collect()} == {"o", "a", "b", "c", "q", "gone"}
    nodes = spark.createDataFrame([("a", "T", "v", {"p": "1", "q": "2"}), ("b", "T", "v", None)], NODES)
    changes = spark.createDataFrame([("a", {"p": "9", "z": "1"}, ["q"])], "dedupe_key string, put map<string,string>, cut array<string>")
    assert {r.dedupe_key: r.properties for r in V.update_nodes(nodes, changes).collect()} == {"a": {"p": "9", "z": "1"}, "b": None}


def test_sorted_window_split(spark):
    """Cutting a type into many ranges gives the same pairs as one."""
    rows = [(f"T|{i}", "T", f"v{i * 7919 % 300:04}", i) for i in range(300)] + [("U|1", "U", "a", 1), ("U|2", "U", "b", 2), ("V|1", "V", None, 1)]
    nodes = spark.createDataFrame(rows, "dedupe_key string, node_type string, primary_value string, seq long")
    order = {t: sorted((r[2], r[0]) for r in rows if r[1] == t and r[2]) for t in "TUV"}
    want = {(t, *sorted((o[i][1], o[j][1]))) for t, o in order.items() for i in range(len(o)) for j in range(i + 1, min(i + 5, len(o)))}
    for ranges in (1, 3, 40):
        got = G.sorted_window_pairs(nodes, ranges=ranges).collect()
        assert len(got) == len(want)
        assert {(r.node_type, r.key_a, r.key_b) for r in got} == want
