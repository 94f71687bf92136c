"""The whole pipeline against a composition of plain versions."""

from collections import Counter

import brute
import corpus_pipeline
from test_brute import SCHEMA, some_rows

from graphweave.llm import source_mix, toxicity


def plain(rows, labels):
    scores = brute.toxic_scores([r[:2] for r in rows], labels)
    kept = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    largest = {}
    for r in kept:
        key = brute.ascii_low(r[1])
        if key not in largest or (-1 if r[0] is None else r[0]) > (-1 if largest[key][0] is None else largest[key][0]):
            largest[key] = r
    kept = list(largest.values())
    size, root = brute.jaccard_classes([r[:2] for r in kept])
    least = {}
    for i, r in enumerate(kept):
        k = root[i] if size[i] else ("empty", i)
        if k not in least or (r[0] is None, r[0] or 0) < (least[k][0] is None, least[k][0] or 0):
            least[k] = r
    kept = list(least.values())
    copies, _ = brute.mix_copies([(d, t, s) for d, t, _, s in kept], source_mix.MAX_REPEATS)
    return Counter(x for x, c in zip(brute.bpe([r[:2] for r in kept]), copies, strict=True) for _ in range(c))


def test_run(spark, tmp_path):
    rows, labels = some_rows()
    base = " ".join(f"word{i}" for i in range(60))
    rows += [(300, base, "en", "mid"), (301, base + " more", "en", "small"), (302, base.upper(), "en", "mid"), (None, base + " x", "en", "big"), (303, base[:-7] + " y z", "fr", "big")]
    where = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA + "").selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, where).collect()))
    assert got == plain(rows, labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "source mix", "BPE"]


def test_run_empty(spark, tmp_path):
    where = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA + ", n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0
