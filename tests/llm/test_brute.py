"""The learning and mixing operators against plain loops, and null and repeated rows through all ten operators."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.llm import (
    bpe, common, exact_dedup, fuzzy_hash, hilbert_shards, jaccard_join, language_id, line_dedup, source_mix, substring_dedup, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string"
CLEAN, BAD = "calm river walk garden quiet morning light friend".split(), "vile scum idiot trash hateful stupid".split()


def some_rows(n=240, seed=4):
    """Clean and toxic texts of three sources, with nulls, repeats and shared ids."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 5
        text = " ".join(rng.choice(CLEAN, 12).tolist() + (rng.choice(BAD, 5).tolist() if bad else rng.choice(CLEAN, 5).tolist()))
        rows.append((i, text + f" t{i}", "en" if i % 2 else "fr", ("big", "big", "mid", "small")[i % 4] if i % 8 else "big"))
        labels.append((i, int(bad)))
    rows += [(None, rows[0][1], "en", "big"), (None, None, None, None), (7, rows[7][1], "fr", "small"), (7, "another text under one id", "en", "mid"), (9, "", "en", None), (1000, rows[1][1].upper(), "en", "mid")]
    return rows, labels


def test_source_mix(spark):
    rows, _ = some_rows()
    got = source_mix.source_mix(spark.createDataFrame(rows, SCHEMA), max_repeats=2.5).collect()
    want, epochs = brute.mix_copies([(d, t, s) for d, t, _, s in rows], 2.5)
    assert Counter((r.doc_id, r.source, r.copies) for r in got) == Counter((d, s, c) for (d, _, _, s), c in zip(rows, want, strict=True))
    assert {r.source: pytest.approx(r.epochs, abs=1e-4) for r in got} == epochs
    none = spark.createDataFrame([(1, "a b c", "en", "one"), (2, "d e", "en", "one")], SCHEMA)
    assert {r.copies for r in source_mix.source_mix(none).collect()} == {1}


def test_toxicity(spark):
    rows, labels = some_rows()
    got = toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")).collect()
    want = brute.toxic_scores([r[:2] for r in rows], labels)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(r[0]), round(s, 9)) for r, s in zip(rows, want, strict=True))
    assert {r.held_out for r in got} == {True, False} and all(r.predicted == int(r.score >= 0.3) for r in got)


def test_sample(spark):
    """A share far under a millionth still draws rows; what repeats is taken once; bytes bound it, and a rerun takes the same."""
    text = F.concat(F.lit("text "), F.col("doc_id").cast("string"))
    rows = spark.range(2_000_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert 0 < common.bounded_sample(rows, 5 / 2_000_000, 5, 1000).count() <= 10
    same = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("text"))
    assert common.bounded_sample(same, 2, 20, 1000).count() == 1
    other = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("text"))
    assert common.bounded_sample(other, 2, 20, 1000).count() == 40
    some = spark.range(1000).select(F.col("id").alias("doc_id")).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.repeat(text, F.lit(100))).otherwise(text))
    got = [sorted(r.doc_id for r in common.bounded_sample(x, 2, 500, 4000).collect()) for x in (some, some.repartition(7))]
    assert got[0] == got[1] and 0 < len(got[0]) < 500 and some.where(F.col("doc_id").isin(got[0])).agg(F.sum(F.length("text"))).first()[0] <= 4000


def test_long_texts_are_learned_from(spark):
    """A text of any length is learned from while the sample has room for it."""
    rows = [(i, " ".join(["vile" if i % 2 else "calm"] * 3 + [f"w{i}x{k}" for k in range(9000)]), "en", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame([*rows, (100, "vile", "en", "s"), (101, "calm", "en", "s")], SCHEMA), labels).collect()}
    assert len(rows[0][1]) > 1 << 15 and got[100] > got[101]


def test_language_id(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.choice(64, 9, replace=False).tolist(), rng.integers(1, 5, 9).astype(float).tolist(), i % 3) for i in range(60)]
    rows = [([g + 64 * label for g in grams], counts, label) for grams, counts, label in rows]
    kept = language_id.BITS
    score, temperature, threshold = language_id.fit([(np.array(g), np.array(c), k) for g, c, k in rows], 3)
    want = np.array(brute.softmax_fit(rows, 3, kept, language_id.WIDTH))
    assert np.abs(score - want).max() < 1e-9 and 0 < temperature <= 5 and 0 <= threshold <= 0.99
    texts = [(i, ("le chat est dans la maison verte " if i % 2 else "the cat is in the green house ") * (1 + i % 3), "fr" if i % 2 else "en", "s") for i in range(90)]
    got = language_id.language_id(spark.createDataFrame([*texts, (None, "le chat verte", None, None), (200, "12 34", "en", "s")], SCHEMA)).collect()
    assert all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in got if r.doc_id is not None and r.doc_id < 90)
    assert {r.doc_id: r.lang_pred for r in got}[None] == "fr" and {r.doc_id: r.lang_pred for r in got}[200] == "und"


def test_nulls_and_repeats(spark):
    """One row per row of input, whatever repeats or lacks an id; equal rows have equal results."""
    rows, labels = some_rows(40)
    frame = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    outs = {
        "bpe": bpe.query(frame), "mix": source_mix.source_mix(frame), "lines": line_dedup.query(frame), "jaccard": jaccard_join.jaccard_join(frame), "exact": exact_dedup.exact_dedup(frame),
        "toxicity": toxicity.toxicity(frame, marks), "language": language_id.language_id(frame), "fuzzy": fuzzy_hash.query(frame), "shards": hilbert_shards.hilbert_shards(frame), "substring": substring_dedup.query(frame),
    }
    for name, out in outs.items():
        got = [r.doc_id for r in out.collect()]
        assert Counter(got) == Counter(r[0] for r in rows), name
    assert Counter(map(tuple, outs["jaccard"].collect())) == Counter(brute.jaccard_join([r[:2] for r in rows]))
    assert Counter(map(tuple, outs["bpe"].collect())) == Counter(brute.bpe([r[:2] for r in rows]))
    assert sorted(map(str, (tuple(r) for r in outs["fuzzy"].collect()))) == sorted(map(str, brute.fuzzy_hash([r[:2] for r in rows])))


def test_repeated_rows_of_one_document(spark):
    """Rows equal in id and text are one document: neither repeats the other."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (6, text), (None, text), (None, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 30, 30), ("5", 30, 30), ("6", 30, 30), ("None", 0, 0), ("None", 30, 0)]


def test_drop_copies_by_row(spark):
    rows = [(5, "A"), (5, "B"), (3, "a"), (3, "b"), (None, "A"), (None, "C"), (None, "c"), (7, "D"), (7, "D"), (7, "d"), (8, None), (9, "")]
    for support in (1 / 10_000, 0.2):
        got = Counter((r.doc_id, (r.text or "").lower()) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), support).collect())
        assert got == Counter([(5, "a"), (5, "b"), (None, "c"), (7, "d"), (9, "")])


def test_fuzzy_hash_hot_id(spark):
    """Rows of one id, or of none, are in as many ranges as they fill; copies of one text are one row per task."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice(CLEAN, 8).tolist()) + f" {rng.integers(0, 10**9)}"
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text()) for i in range(900)] + [(None, "the same text again")] * 300 + [(8, None)] * 40 + [(8, "")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = fuzzy_hash.with_next(frame, 2000).where("not borrowed").groupBy("range").agg(F.count("*").alias("n"), F.sum("n").alias("rows")).collect()
    assert len(ranges) > 15 and max(r.n for r in ranges) < 120 and sum(r.rows for r in ranges) == len(rows)
    for range_bytes in (700, 1 << 24):
        got = Counter(map(str, (tuple(r) for r in fuzzy_hash.query(frame, range_bytes).collect())))
        assert got == Counter(map(str, brute.fuzzy_hash(rows)))


def test_texts_without_ids(spark):
    """A third of the rows lack an id: the join of texts to sets has a row per set, however many they are."""
    for n in (60, 240):
        base = [f"{i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(n // 2)]
        rows = [(None if i % 3 == 0 else i, base[i // 2] + (" more" if i % 2 else "")) for i in range(n)] + [(None, base[0])] * 50 + [(5, base[1])] * 50
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        sets, chosen = jaccard_join.shingle_sets(frame), None
        reps = jaccard_join.named_sets(sets)
        chosen = reps.select(*jaccard_join.ROW, F.monotonically_increasing_id().alias("set"))
        assert jaccard_join.texts_of(chosen, frame).count() == reps.count() == n
        assert Counter(map(tuple, jaccard_join.jaccard_join(frame).collect())) == Counter(brute.jaccard_join(rows))


def test_frequent_in_levels(spark):
    """All values over the share are named, from many partitions, and no task gets the sketches of all of them."""
    rows = spark.range(0, 200_000, 1, 100).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("hot"), (F.col("id") % 150).cast("string"))).otherwise(F.col("id").cast("string")).alias("hash"))
    out = common.frequent(rows, "hash", 1 / 200)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.item for r in out.collect()} == {brute.signed_hash(f"hot{k}") for k in (0, 50, 100)}
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert common.frequent(rows.limit(0), "hash", 0.1).count() == 0


CLASHING = ("__row", "__class", "__n", "__e", "__id", "doc", "text_hash", "text_sha256", "keep_id", "score", "n", "block", "copies", "node", "range")


def test_clashing_columns(spark):
    """Stages that return documents keep columns of any name as they were."""
    rows, labels = some_rows(60)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("label"))
    for out in (exact_dedup.drop_copies(frame), jaccard_join.drop_near_copies(frame), source_mix.mixed(frame), toxicity.drop_toxic(frame, marks)):
        assert out.columns == frame.columns
        got = out.collect()
        assert got and all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHING)
    for op in (bpe.query, line_dedup.query, jaccard_join.jaccard_join, exact_dedup.exact_dedup, language_id.language_id, fuzzy_hash.query, hilbert_shards.hilbert_shards, substring_dedup.query, source_mix.source_mix):
        assert op(frame).count() == len(rows)


def test_very_long_texts(spark):
    """A text of some megabytes among short ones, through each operator: results as of plain versions, or of its parts."""
    words_ = [f"w{i * 7919 % 100_003}" for i in range(100_003)]
    long, twin = " ".join(words_ * 3), " ".join(words_ * 3 + ["more"])
    lines = "\n".join(f"line number {i} of a long text" for i in range(60_000))
    rows = [(1, long, "en", "a"), (2, twin, "en", "a"), (3, lines, "en", "b"), (4, "line number 7 of a long text\nx", "en", "b"), (5, "Line number 7 of a long text ", "en", "b"), (6, "short", "fr", "b"), (7, long.upper(), "fr", "a")]
    frame, pairs = spark.createDataFrame(rows, SCHEMA), [r[:2] for r in rows]
    kept = {r.doc_id: r for r in exact_dedup.exact_dedup(frame).collect()}
    assert kept[1].keep_id == 7 and kept[1].group_size == 2 and kept[2].kept
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(frame).collect()}
    assert linked[1] == (100_003, 1) and linked[2] == (100_004, 1) and linked[7] == (100_003, 1) and linked[3][1] == 3
    dropped = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.query(frame).collect()}
    assert dropped[3] == (60_000, 1) and dropped[4] == (2, 1) and dropped[5] == (1, 0) and dropped[1] == (1, 0)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.query(frame).collect()}
    assert cut[1] == (300_009, 200_006) and cut[2] == (300_010, 300_009) and cut[7] == (300_009, 200_006)
    assert {r.doc_id: r.lang_pred for r in language_id.language_id(frame).collect()}.keys() == {r[0] for r in rows}
    scored = toxicity.toxicity(frame, spark.createDataFrame([(4, 0), (6, 1)], "doc_id long, toxic int")).collect()
    assert len(scored) == 7 and all(0 <= r.score <= 1 for r in scored)
    copies = {r.doc_id: r.tokens for r in source_mix.source_mix(frame).collect()}
    assert copies[1] > 300_000 and copies[6] == 1
    shards = {r.doc_id: r for r in hilbert_shards.hilbert_shards(frame).collect()}
    assert shards[1]["size"] == len(long) + 1 and len(shards) == 7
    prints = Counter(map(str, (tuple(r) for r in fuzzy_hash.query(frame).collect())))
    assert sum(prints.values()) == 7 and len({r.fingerprint for r in fuzzy_hash.fingerprint(frame).where("doc_id in (1, 2)").collect()}) == 2
    assert {r.doc_id: r.n_tokens > 100_000 for r in bpe.query(frame).collect()}[1] and pairs
