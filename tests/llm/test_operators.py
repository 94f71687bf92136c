"""Small cases against brute force: nulls, empty and repeated rows, ties, empty tables, clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from graphweave.llm import (
    bpe,
    exact_dedup,
    fuzzy_hash,
    hilbert_shards,
    jaccard_join,
    language_id,
    line_dedup,
    source_mix,
    substring_dedup,
    toxicity,
)

BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE.upper(), "en", "a"), (3, BASE + " more", "en", "b"), (4, None, None, None), (5, "", "fr", "a"),
    (6, "x y z", "fr", "b"), (7, "X y z", "de", None), (8, f"head\n  A line that is long enough.\n{BASE}", "en", "a"),
    (9, "a line that is long enough. \nother", "en", "a"), (10, "A LINE THAT IS LONG ENOUGH.\n\n", "en", "b"), (11, "é" * 3000, "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use inside
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"hash": F.lit(1), "node": F.lit(2), "tokens": F.lit(3), "seq": F.lit(4), "label": F.lit(5)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_rows():
    return [(r[0], r[1]) for r in ROWS]


def test_exact_dedup(docs, none):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert [i for i, r in got.items() if not r.kept] == [1, 4, 6] or sorted(i for i, r in got.items() if not r.kept) == [1, 4, 6]
    assert got[1].keep_id == 2 and got[4].group_size == 2 and got[4].keep_id == 5
    assert exact_dedup.exact_dedup(none).count() == 0


def test_line_dedup(docs, none):
    got = {r.doc_id: r for r in line_dedup.query(docs).collect()}
    assert [(i, got[i].n_lines, got[i].n_dropped) for i in (4, 8, 9, 10)] == [(4, 1, 0), (8, 3, 1), (9, 2, 1), (10, 3, 0)]
    assert got[9].kept_sha256 == hashlib.sha256(b"other").hexdigest()
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs).collect()}[8] == 1
    assert line_dedup.query(none).count() == 0


def test_jaccard_join(docs, none):
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect())) == sorted(brute.jaccard_join(text_rows()))
    assert jaccard_join.jaccard_join(none).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_trie_links(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 60, 25)
    sets = []
    for _ in range(40):
        s = np.where(rng.random(25) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 60, 25), base)
        sets.append(np.unique(s[: rng.integers(1, 26)]).astype(np.uint64))

    def classes(links):
        up = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    pairs = [(i, j) for i in range(40) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert classes(jaccard_join.trie_links(sets)) == classes(pairs)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    own, band = rng.random(40) < 0.6, rng.integers(0, 2, 40)
    assert classes(jaccard_join.trie_links(sets, own, band)) == classes([(i, j) for i, j in pairs if (own[i] or own[j]) and band[i] != band[j]])


def test_drop_near_copies_by_row(spark, docs, none):
    """Rows that share a doc_id, or have none, stay or go by their own text."""
    other = " ".join(f"other{i}" for i in range(60))
    third = " ".join(f"third{i}" for i in range(60))
    rows = [(5, "own text without a copy", "en", "A"), (5, BASE + " more", "en", "B"), (3, BASE, "en", "B'"), (None, BASE + " x", "en", "B''"),
            (None, other, "en", "C"), (None, other + " x", "en", "C'"), (None, "a text of its own", "en", "D"), (None, None, "en", "E"), (8, None, "en", "F"),
            (7, third, "en", "G"), (7, third, "en", "G"), (7, third + " x", "en", "G")]
    got = sorted((r.source[0], r.source) for r in jaccard_join.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [s for _, s in got if s[0] != "C"] == ["A", "B'", "D", "E", "F", "G"] and sum(s[0] == "C" for _, s in got) == 1
    assert jaccard_join.drop_near_copies(docs).columns == docs.columns
    assert jaccard_join.drop_near_copies(none).count() == 0


def substring_rows(frame, **limits):
    got = substring_dedup.substring_dedup(frame, **limits).collect()
    assert all(sum(x.words for x in r.spans) == r.n_removed and all(x.words >= 20 for x in r.spans) for r in got)
    return sorted(tuple(r)[:4] for r in got)


def test_substring_dedup(docs, none):
    want = brute.substring_dedup(text_rows())
    assert substring_rows(docs) == want
    hashed = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in want]
    assert sorted(map(tuple, substring_dedup.query(docs).collect())) == hashed
    assert substring_dedup.query(none).count() == 0


def test_substring_dedup_shared_phrase(spark, monkeypatch):
    """A phrase of ten words in many texts is no repeat of twenty, however often it occurs; one of twenty-two is."""
    phrase = " ".join(f"p{i}" for i in range(10))
    full = " ".join(f"q{i}" for i in range(22))
    text = lambda i: " ".join(f"w{(i * 31 + k * 17) % 9973}x{k}" for k in range(12))
    rows = [(i, f"{text(i)} {phrase} {text(i + 5000)}" + (f" {full} {text(i + 1)}" if i % 50 == 0 else "")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.substring_dedup(rows)
    assert sum(n for _, _, n, _ in want) < 22 * 60 + 1
    for limit, most in ((10, 1_000_000), (10, 0), (500_000, 1_000_000)):  # with some prefixes extended, with all, and without
        monkeypatch.setattr(substring_dedup, "MOST_LARGE", most)
        marks = substring_dedup.repeated_windows(frame, bucket_windows=limit)
        assert sum(len(r.starts) // 4 for r in marks.collect()) == 59 * 3
    assert substring_rows(frame) == want


def test_bpe(docs, none):
    rows = [*text_rows(), (12, "abc" * 9000), (13, " <|endoftext|> x" * 20), (14, "many words " * 12000)]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, bpe.query(frame).collect())) == sorted(brute.bpe(rows))
    assert bpe.query(none).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(frame))
    assert sorted(tuple(r) for r in back.select("doc_id", "text").collect()) == [(i, t or "") for i, t in rows]


def test_bpe_long_unsplit(docs):
    """Two million letters without white space: rows of their own, encoded in parallel and joined up the tree."""
    rng = np.random.default_rng(3)
    rows = [(1, "".join(map(chr, rng.integers(97, 123, 2_000_000)))), (2, "ab" * 1_000_000)]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, bpe.query(frame).collect())) == sorted(brute.bpe(rows))


LONG_RUNS = ["漢字かな交じり文", "漢字、かな。", "'ll", "'", "a!", "12", " ", "\n", "é", "ab<|endoftext|>", "'s<|endo", "x\u0301"]


def test_bpe_unbroken_tail(docs):
    """Leading words before a longer tail without breaks, whole and cut into rows."""
    rows = [(1, "word " * 2000 + "漢" * 12000), (2, "word " * 4000 + "漢字、" * 14000), (3, "漢" * 12000 + " word" * 2000)]
    rows += [(10 + i, "some words " * 300 + unit * (230_000 // len(unit)) + " and more" * 9000) for i, unit in enumerate(LONG_RUNS)]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, bpe.query(frame).collect())) == sorted(brute.bpe(rows))
    parts = [len(t) for _, t in bpe.load(bpe.default_path()).unbroken("漢" * 230_000)]
    assert max(parts) <= bpe.PART and sum(parts) == 230_000


@pytest.mark.parametrize("range_bytes", [1, 300, 1 << 24])
def test_fuzzy_hash(docs, none, range_bytes):
    """Each document's own, edited and next fingerprint, compared by a plain edit distance, however the rows are dealt."""
    rows = [*text_rows(), (None, "a null id comes last " * 9), (3, BASE + " twice"), (3, BASE + " twice")]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    show = lambda out: sorted(out, key=str)
    assert show(map(tuple, fuzzy_hash.query(frame, range_bytes).collect())) == show(brute.fuzzy_hash(rows))
    assert fuzzy_hash.query(none, range_bytes).count() == 0


def test_places():
    assert fuzzy_hash.fingerprints([b""]) == ["3::"]
    long = np.random.default_rng(5).integers(97, 123, 300_000, dtype=np.uint8).tobytes()
    assert fuzzy_hash.fingerprints([long, long[:150_000] + b"x" + long[150_000:]]) == [brute.fingerprint(t) for t in (long, long[:150_000] + b"x" + long[150_000:])]


def test_hilbert(docs, none):
    cells = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    frame = docs.sparkSession.createDataFrame(cells, "a int, b int, c int")
    path = frame.withColumn("h", hilbert_shards.hilbert([F.col("a"), F.col("b"), F.col("c")], 2)).orderBy("h").collect()
    assert [r.h for r in path] == list(range(64))
    assert all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in zip(path, path[1:], strict=False))
    got = hilbert_shards.hilbert_shards(docs).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(ROWS) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert hilbert_shards.hilbert_shards(none).count() == 0


def test_hilbert_brute(spark):
    """Slots follow the curve; strings that begin alike still part the curve; cells of many buckets stay whole."""
    rows = [(i, "w " * (1 + i * 37 % 101), "en" if i % 3 else None, f"https://www.example.org/{i % 16:02}") for i in range(900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    slim = frame.select("doc_id", (F.octet_length("text") + 1).alias("size"), F.crc32("text").alias("text_crc32"), "source")
    spread, axes = hilbert_shards.curve(slim, ["source", "size"], 4)
    cells = spread.toPandas()
    assert cells[axes[0]].nunique() >= 14 and cells[axes[1]].nunique() >= 15
    assert (cells.sort_values("source")[axes[0]].diff().dropna() >= 0).all()
    placed = hilbert_shards.ranked(slim.withColumn("x", (F.col("doc_id") % 4 * 4 % 16).cast("int")).withColumn("y", F.lit(1)), ["x", "y"], 4, 7).toPandas()
    assert sorted(placed["rank"]) == list(range(900))
    assert (placed.sort_values("rank").hilbert.diff().dropna() >= 0).all()
    got = hilbert_shards.hilbert_shards(frame, shards=7).toPandas()
    order = got.sort_values(["shard", "slot"])
    assert (order.hilbert.diff().dropna() >= 0).all() and sorted(got.groupby("shard").size()) == [128] * 3 + [129] * 4


def test_hilbert_plain(spark):
    """Shards, slots and places on the curve against a plain walk over the sorted rows, whose order within a cell is the operator's own."""
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 90)), rng.choice(["en", "de", "fr"]).item(), f"s{rng.integers(0, 6)}") for i in range(400)] + [(900, None, None, None), (901, "", "en", None)] + [(902, "same", "en", "s1")] * 3
    got = hilbert_shards.hilbert_shards(spark.createDataFrame(rows, SCHEMA), shards=6).toPandas().sort_values(["shard", "slot"])
    size = lambda t: len((t or "").encode()) + 1
    values = [[r[2] for r in rows], [r[3] for r in rows], [size(r[1]) for r in rows]]
    cuts = []
    for column in values:
        known = sorted(v for v in column if v is not None)
        cuts.append(sorted({known[len(known) * i >> 4] for i in range(1, 16)}))
    cell = [tuple(sum(v >= c for c in cut) if v is not None else 0 for v, cut in zip(vs, cuts, strict=True)) for vs in zip(*values, strict=True)]

    def place(x):
        """Skilling's walk from axes to the transposed index, in plain numbers."""
        x, n = list(x), 3
        for q in (8, 4, 2):
            for i in range(n):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
        for i in range(1, n):
            x[i] ^= x[i - 1]
        t = 0
        for q in (8, 4, 2):
            t ^= q - 1 if x[n - 1] & q else 0
        return int("".join(str((v ^ t) >> b & 1) for b in (3, 2, 1, 0) for v in x), 2)

    want = sorted(place(c) for c in cell)
    assert got.hilbert.tolist() == want and got.groupby("shard").size().tolist() == [68] * 3 + [67] * 3
    assert sorted(zip(got.doc_id, got["size"], got.hilbert, strict=True)) == sorted((r[0], size(r[1]), place(c)) for r, c in zip(rows, cell, strict=True))
    assert [s for _, g in got.groupby("shard") for s in g.slot] == [i for n in [68] * 3 + [67] * 3 for i in range(n)]


def test_hilbert_files(spark, tmp_path):
    """A filter on any dimension leaves most files unread; all rows and columns are there."""
    import glob

    import pyarrow.parquet as pq

    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 200)), f"l{rng.integers(0, 16):02}", f"s{rng.integers(0, 16):02}" if i % 3 else "s05") for i in range(6000)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(7))
    hilbert_shards.write_shards(frame, f"file://{tmp_path}/shards", files=64)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.columns == ["doc_id", "text", "lang", "source", "more", "size"] and sorted(map(str, back.drop("size").collect())) == sorted(map(str, frame.collect()))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/shards/*.parquet")]
    assert len(files) > 50 and max(m.num_rows for m in files) < 4 * len(rows) / len(files)

    def unread(column, low, high):
        at = back.columns.index(column)
        return sum(all(not g.statistics.has_min_max or g.statistics.max < low or g.statistics.min > high for g in (m.row_group(k).column(at) for k in range(m.num_row_groups))) for m in files) / len(files)

    assert unread("lang", "l03", "l03") > 0.5 and unread("source", "s09", "s09") > 0.5 and unread("size", 10, 20) > 0.5
    hilbert_shards.write_shards(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", files=3)
    assert spark.read.parquet(f"file://{tmp_path}/none").count() == 0


def test_source_mix(spark, docs, none):
    rows = [(i, "w " * 10, "en", "big" if i < 80 else "small") for i in range(100)]
    got = source_mix.source_mix(spark.createDataFrame(rows, SCHEMA), max_repeats=2.0).toPandas()
    assert set(got[got.source == "big"].copies) == {1}
    small = got[got.source == "small"]
    assert small.epochs.iloc[0] <= 2.0 + 1e-6 and small.copies.sum() >= 38
    assert got.groupby("source").weight.first().sum() == pytest.approx(1)
    assert source_mix.mixed(spark.createDataFrame(rows, SCHEMA), max_repeats=2.0).count() == got.copies.sum()
    assert source_mix.source_mix(docs).count() == len(ROWS) and source_mix.source_mix(none).count() == 0


def test_drop_toxic_by_row(spark, none):
    """With labels: clean rows stay, whoever shares their doc_id or has none either."""
    clean, bad = "a quiet walk along the river today", "vile hateful insult scum idiot"
    rows = [(i, bad if i % 2 else clean, "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    more = [(None, bad, "en", "bad"), (None, clean, "en", "1"), (900, bad, "en", "bad"), (900, clean, "en", "2")]
    frame = spark.createDataFrame(rows + more, SCHEMA).withColumn("score", F.lit(1))
    got = toxicity.drop_toxic(frame, labels)
    assert got.columns == frame.columns
    kept = got.collect()
    assert sorted(r.source for r in kept if r.source != "s") == ["1", "2"]
    assert {r.text for r in kept} == {clean} and sum(r.source == "s" for r in kept) == 200
    assert toxicity.drop_toxic(none, labels).count() == 0


def test_classifiers(spark, docs, none):
    d = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    tox = toxicity.toxicity(real, labels)
    q = brute.quality(tox.toPandas(), labels.toPandas())
    assert q["precision"] >= 0.7 and q["recall"] >= 0.5  # of few labels
    lang = language_id.language_id(real).toPandas().merge(real.select("doc_id", "lang").toPandas(), on="doc_id")
    held = lang[lang.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95
    none_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none_labels).count() == len(ROWS) and toxicity.toxicity(none, none_labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, none_labels).collect()} == {0}
    assert toxicity.drop_toxic(docs, none_labels).count() == len(ROWS)
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    assert got[4] == got[5] == "und" and language_id.language_id(none).count() == 0
