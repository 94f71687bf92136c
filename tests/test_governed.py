"""Sources, plans, execution, findings and lists on small fixtures: nulls, empty tables, repeats."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from graphweave.functions.text import sanitize
from graphweave.operators import detect as T
from graphweave.operators import documents as D
from graphweave.operators import governance as V
from graphweave.operators import reads as R
from graphweave.operators import write as W
from graphweave.sources import documents as X
from graphweave.sources import hashing

MAP = "map<string,string>"


def test_file_type_and_text(spark):
    rows = [("a.PDF", b"x"), ("dir.v1/readme", b"text"), ("x", b"%PDF-1"), ("x", b"PK\x03\x04z"), ("x", b"\xff\xfe"), ("y.docx", b""), ("z.tar.gz", b"a"), (".txt", b"a"), ("b.md", b"caf\xe9"), ("c.txt", b" \n"), ("d.epub", b"a"), (None, None)]
    frame = spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, (n, c) in enumerate(rows)], "doc_id long, name string, content binary")
    kinds = [r[0] for r in frame.orderBy("doc_id").select(X.file_type(F.col("name"), F.col("content"))).collect()]
    assert kinds[:11] == ["pdf", "text", "pdf", "docx", "unknown", "docx", "unknown", "text", "text", "text", "unknown"]
    got = {r.doc_id: (r.text, r.error) for r in X.raw_text(frame).collect()}
    assert got[8] == ("café", None) and got[9] == (None, "empty_text") and got[0] == (None, "unsupported_type") and got[1] == ("text", None)
    assert X.raw_text(frame.where("false")).count() == 0


def test_binary_files(spark, tmp_path):
    (tmp_path / "full.bin").write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")
    got = {r.name: (r.size, bytes(r.content)) for r in X.binary_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"full.bin": (3, b"abc")}


def test_file_hashes(spark, tmp_path, monkeypatch):
    """Files of any size are hashed in bounded parts, whatever their name and wherever they end; files that can't be read in parts, whole."""
    monkeypatch.setattr(X, "WHOLE", 64)
    monkeypatch.setattr(hashing, "RECORD", 16)
    monkeypatch.setattr(hashing, "RECORDS", 4)
    sizes = {"none": 0, "one": 1, "whole": 64, "more": 65, "a,b{c}[d]*?.bin": 1000, "ab{c}[d]xy.bin": 999, "text.gz": 90, "_k=v": 80} | {f"n{i}": i for i in (70, 71, 80, 127, 128, 129, 134, 135, 160, 161)}
    bodies = {n: bytes(i * 31 % 251 for i in range(k)) for n, k in sizes.items()}
    for n, body in bodies.items():
        (tmp_path / n).write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # what the reader takes as a row
    try:
        got = sorted(map(tuple, X.file_hashes(spark, f"file://{tmp_path}").collect()))
        assert got == sorted((n, len(b), sha256(b).hexdigest()) for n, b in bodies.items() if b)
        few = X.file_hashes(spark, f"file://{tmp_path}", "n1*").select("name", "size", "content_hash")
        assert {r.name for r in few.collect()} == {n for n in bodies if n.startswith("n1")}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_hash_states():
    """A state holds all of a stream before it, and one that has seen another number of bytes is refused."""
    state = hashing.begun()
    for piece in (b"a" * 63, b"", b"b" * 130, b"c"):
        state = hashing.extended(state, [piece])
    assert hashing.digest(state, 194) == sha256(b"a" * 63 + b"b" * 130 + b"c").hexdigest()
    with pytest.raises(ValueError):
        hashing.digest(state, 195)


def test_elements(spark):
    text = "# Head\nmore\n\n  - item\n\nplain\n\n\n\n| a | b |\n| --- | :-: |\n| 1 | 2 |\n\n1) one\n\n#no head"
    frame = spark.createDataFrame([(1, text), (2, None), (3, " \n\n "), (4, "one\ntwo")], "doc_id long, text string")
    got = [(r.doc_id, r.pos, r.element_type) for r in D.elements(frame).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "heading"), (1, 1, "list_item"), (1, 2, "paragraph"), (1, 4, "table"), (1, 5, "list_item"), (1, 6, "paragraph"), (4, 0, "paragraph")]


def test_sanitize(spark):
    frame = spark.createDataFrame([(" a   b\t\n",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(sanitize(F.col("t"))).collect()] == ["a b", "", None]


def test_plan_steps(spark):
    schema = "proposal_id long, proposal_class string, pos long, element_type string, dedupe_key string, new_type string, start_key string, end_key string"
    rows = [
        (1, "normalize", 0, "relationship", "r1", "NEW", "s", "e"), (1, "normalize", 1, "node", "n1", None, None, None), (1, "normalize", 2, "relationship", "r2", "NEW", "", "e"),
        (2, "merge", 0, "node", "z", None, None, None), (2, "merge", 1, "node", "a", None, None, None), (2, "merge", 2, "relationship", "r", None, None, None),
        (3, "merge", 0, "relationship", "b", None, None, None), (3, "merge", 1, "relationship", "a", None, None, None), (4, "merge", 0, "node", "a", None, None, None),
        (5, "delete", 0, "node", "n", None, None, None), (5, "delete", 1, "relationship", "y", None, None, None), (5, "delete", 2, "other", "x", None, None, None), (6, "defer", 0, "node", "n", None, None, None),
        (7, "normalize", 0, "relationship", "b", None, "s", "e"), (7, "normalize", 1, "node", "a", None, None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = [(r.proposal_id, r.step, r.operation, r.dedupe_key, r.merge_keys, r.rel_type) for r in V.plan_steps(frame).orderBy("proposal_id", "step").collect()]
    assert got == [
        (1, 0, "delete_edge", "r1", None, None), (1, 1, "create_edge", "NEW::s::e::v1", None, "NEW"), (2, 0, "merge_nodes", "z", ["z", "a"], None), (3, 0, "delete_edge", "a", None, None),
        (5, 0, "delete_edge", "y", None, None), (5, 1, "delete_node", "n", None, None), (7, 0, "update_node", "a", None, None), (7, 1, "update_edge", "b", None, None),
    ]
    assert V.plan_steps(frame.where("false")).count() == 0


def test_merge_twice_changes_nothing(spark):
    """First properties stay, the last run stamps; a second delivery only matches."""
    schema = f"dedupe_key string, node_type string, run_id string, schema_version string, properties {MAP}"
    new = spark.createDataFrame([("a", "T", "run2", "v", {"p": "2", "_q": "x"}, 2), ("a", "T", "run1", "v", {"p": "1"}, 1), ("b", "T", "run2", "v", None, 3)], schema + ", seq long")
    old = spark.createDataFrame([("b", "T", "run0", "v", {"o": "1"}), ("c", "T", "run0", "v", {})], schema)
    out, acts = W.merge_nodes(old, new)
    assert sorted((r.dedupe_key, r.run_id, r.properties) for r in out.collect()) == [("a", "run2", {"p": "1"}), ("b", "run2", {"o": "1"}), ("c", "run0", {})]
    assert sorted((r.dedupe_key, r.created, r.matched) for r in acts.collect()) == [("a", 1, 1), ("b", 0, 1)]
    again, acts = W.merge_nodes(out.drop("last_seen"), new)
    assert sorted((r.dedupe_key, r.created, r.matched) for r in acts.collect()) == [("a", 0, 2), ("b", 0, 1)]
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect())) or again.count() == 3


def test_execute(spark):
    plans = spark.createDataFrame([(i, "run1") for i in range(1, 6)], "plan_id long, run_id string")
    codes = spark.createDataFrame([(1, None), (2, "approval_not_found"), (3, None), (4, None), (5, None)], "plan_id long, code string")
    step = "plan_id long, operation string, dedupe_key string, merge_keys array<string>, rel_type string, start_key string, end_key string, put map<string,string>, cut array<string>"
    rows = [(1, "update_node", "a", None, None, None, None, {"p": "9"}, None), (2, "delete_node", "a", None, None, None, None, None, None), (3, "update_node", "gone", None, None, None, None, {}, None),
            (3, "delete_node", "b", None, None, None, None, None, None), (4, "merge_nodes", "c", ["c", "d"], None, None, None, None, None), (5, "create_edge", "N::a::b::v1", None, "N", "a", "b", None, None)]
    nodes = spark.createDataFrame([(k, "T", "run1", "v1", {"p": "1"}) for k in "abcd"], f"dedupe_key string, node_type string, run_id string, schema_version string, properties {MAP}")
    rels = spark.createDataFrame([("R::a::d::v1", "R", "a", "d", "run1", "v1", {})], f"dedupe_key string, rel_type string, start_dedupe_key string, end_dedupe_key string, run_id string, schema_version string, properties {MAP}")
    frame = spark.createDataFrame(rows, step)
    left, edges, record = W.execute(plans, frame, codes, nodes, rels)
    assert {r.dedupe_key: r.properties["p"] for r in left.collect()} == {"a": "9", "b": "1", "c": "1"}
    assert sorted((r.rel_type, r.start_dedupe_key, r.end_dedupe_key) for r in edges.collect()) == [("N", "a", "b"), ("R", "a", "c")]
    assert sorted((r.plan_id, r.outcome, r.steps_applied, r.code) for r in record.collect()) == [(1, "applied", 1, None), (2, "rejected", 0, "approval_not_found"), (3, "failed", 0, "no_such_element"), (4, "applied", 1, None), (5, "applied", 1, None)]
    same, _, record = W.execute(plans, frame, codes, nodes, rels, dry_run=True)
    assert same.count() == 4 and {r.outcome for r in record.collect()} == {"applied", "rejected"} and {r.steps_applied for r in record.collect()} == {0}


def test_approve(spark):
    rows = [(1, "pending", "merge", None), (2, "pending", "rename", None), (3, "pending", "rename", True), (4, "approved", "merge", None), (5, "rejected", "rename", None), (6, None, None, None)]
    frame = spark.createDataFrame(rows, "proposal_id long, state string, proposal_class string, override boolean")
    assert [r.outcome for r in V.approve(frame).orderBy("proposal_id").collect()] == ["token", "approve", "token", "none", "conflict", "conflict"]


def test_groups(spark):
    rows = [(0, i, f"c{i}", refs) for i, refs in enumerate([["a", "b"], ["x"], ["b", "c"], ["y"], ["z", "z"], ["c", "d"]])]
    found = spark.createDataFrame(rows, "call long, seq long, candidate_id string, refs array<string>")
    assert {r.candidate_id: r.group for r in T.shared_groups(found).collect()} == {"c0": "c0", "c1": "c1", "c2": "c0", "c3": "c3", "c4": "c4", "c5": "c0"}
    assert {r.candidate_id: r.batch for r in T.packed_batches(found, 2).collect()} == {"c0": 0, "c2": 0, "c5": 0, "c1": 1, "c3": 1, "c4": 2}
    assert {r.candidate_id: r.batch for r in T.packed_batches(found, 4).collect()} == {"c0": 0, "c2": 0, "c5": 0, "c1": 0, "c3": 1, "c4": 1}
    assert T.packed_batches(found.where("false")).count() == 0


def test_generate(spark):
    """An orphan that a duplicate names is left out; ids are unique; the stages add up."""
    nodes = spark.createDataFrame([("a", "T", "red bolt", "run1", "v1", 1), ("b", "T", "red bolts", "run1", "v1", 2), ("c", "T", "omega", "run1", "v1", 3), ("d", "U", "zulu", "run1", "v1", 4), ("d", "U", "zulu", "run1", "v1", 5)],
                                  "dedupe_key string, node_type string, primary_value string, run_id string, schema_version string, seq long")
    props = nodes.select("dedupe_key", "node_type", "schema_version", "seq", F.create_map().cast(MAP).alias("properties"))
    rels = spark.createDataFrame([], "dedupe_key string, rel_type string, start_dedupe_key string, end_dedupe_key string, run_id string, schema_version string")
    schema = spark.createDataFrame([("T", "T", "R")], "start_type string, end_type string, rel_type string")
    run = lambda stage: sorted((r.method, r.refs) for r in T.generate(nodes, rels, schema, None, props, {"U": "q"}, "run1", "v1", stage).collect())
    assert run(None) == [("exact_node_dedupe_key", ["d"]), ("jaro_winkler_0.90", ["a", "b"]), ("jaro_winkler_0.90", ["d", "d"]), ("orphan_node", ["c"]), ("qualifier_missing", ["d"])]
    assert [m for m, _ in run(3)] == ["orphan_node"] * 4 + ["qualifier_missing"]
    assert run(1) == [("exact_node_dedupe_key", ["d"])]


def test_page(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    got = R.page(rows, ["k"], 2, 3)
    assert [(r.k, r.total, r.has_more) for r in got.orderBy("k").collect()] == [(3, 7, True), (4, 7, True), (5, 7, True)]
    assert [r.has_more for r in R.page(rows, ["k"], 3, 3).collect()] == [False]
    assert R.page(rows.where("false"), ["k"]).count() == 0 and R.page(rows, ["k"], 0, 0).count() == 1
