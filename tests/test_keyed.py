"""Key prefixes as ranges that skip files; rows of documents that a second call replaces."""

import random
from collections import Counter

from graphweave.sources import keyed


def scanned(df):
    """Rows that the scan read, from the plan that ran."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_scan(spark, tmp_path):
    rng = random.Random(1)
    keys = [f"{a}:{rng.randrange(10**6):06d}" for a in ("job", "lock", "token", "tok") for _ in range(5000)] + ["job", "job:", "joc", "￿", "é"]
    where = f"file://{tmp_path}/keys"
    keyed.store(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v long"), where, files=20)
    for prefix in ("job:", "job:0", "lock:99", "tok", "", "none", "￿", "é"):
        df = keyed.scan(spark, where, prefix)
        assert Counter(r.key for r in df.collect()) == Counter(k for k in keys if k.startswith(prefix)), prefix
    narrow = keyed.scan(spark, where, "lock:99")
    assert len(narrow.collect()) < 100 and scanned(narrow) <= 3000 and "StartsWith" not in narrow._jdf.queryExecution().toString()


def test_after():
    assert keyed.after("ab") == "ac" and keyed.after("a\U0010ffff") == "b" and keyed.after("") is None and keyed.after("\U0010ffff") is None and keyed.after("퟿") == ""


def test_store_documents(spark, tmp_path):
    where = f"file://{tmp_path}/docs"
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, doc_id long, v string")
    read = lambda: Counter((r.run_id, r.doc_id, r.v) for r in spark.read.parquet(where).collect())
    first = [("r1", i, f"a{k}") for i in range(40) for k in range(2)] + [("r2", 1, "b")]
    keyed.store_documents(frame(first), where, 4)
    assert read() == Counter(first)
    keyed.store_documents(frame(first), where, 4)
    assert read() == Counter(first)
    keyed.store_documents(frame([("r1", 3, "new"), ("r3", 3, "c")]), where, 4)
    assert read() == Counter([r for r in first if r[:2] != ("r1", 3)] + [("r1", 3, "new"), ("r3", 3, "c")])
