"""The probable-duplicate detector against a plain version, and known similarities."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphweave.functions.text import STOPWORDS, jaro_winkler_batch, jaro_winkler_of, token_containment
from graphweave.operators import graph as G

SCHEMA = "dedupe_key string, node_type string, primary_value string, run_id string, schema_version string, seq long"
NODES = [("P", "red steel bolt"), ("P", "red steel bolts"), ("P", "steel bolt"), ("P", "bolt steel red large"), ("P", "brass nut"), ("P", "brass nut m4"),
         ("Q", "alpha one"), ("Q", "alpha 0ne"), ("Q", "omega"), ("Q", "  "), ("Q", None), ("P", "ab"), ("P", "x y"), ("P", "x y z"), ("P", "martha"), ("P", "marhta"),
         ("P", "the brass nut"), ("P", "a steel bolt of the year"), ("R", "red"), ("R", "blue ox"), ("P", "brass nut")]
KEYS = [f"{t}|{i}" for i, (t, _) in enumerate(NODES[:-1])] + ["P|4"]  # the last row repeats a key
RELS = [("P|2", "Q|6"), ("P|0", "Q|6"), ("P|0", "Q|8"), ("P|4", "Q|8")]


@pytest.mark.parametrize(("a", "b", "most"), [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "a", 0.0), ("", "", 1.0), ("a", "b", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, most):
    assert round(jaro_winkler_of(a, b), 6) == most


def test_jaro_winkler_batch():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 12)))
    a, b = zip(*[(word(), word()) for _ in range(3000)], strict=True)
    assert jaro_winkler_batch(list(a), list(b)).tolist() == [jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)]
    assert jaro_winkler_batch([], []).tolist() == []


@pytest.mark.parametrize(("a", "b", "want"), [
    ("anna van dijk", "dr anna van dijk", True), ("the red bolt", "red bolt", False), ("bolt", "red bolt", False), ("ab", "ab cd", False),
    ("red bolt", "green bolt", False), ("", "red bolt", False), ("red bolt x", "red bolt large", True), ("how to bolt it", "bolt nut", False),
])
def test_token_containment(spark, a, b, want):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(token_containment(F.col("a"), F.col("b")), token_containment(F.col("b"), F.col("a"))).first() == (want, want)


def plain(focus=None):
    """Rows in the order of value and key, each compared with the next four; then all pairs by tokens."""
    tok = lambda v: set(re.findall("[a-z0-9]+", v.lower()))
    content = lambda v: {t for t in tok(v) if len(t) > 1 and t not in STOPWORDS}
    value = {k: (t, (v or "").strip().lower()) for k, (t, v) in zip(KEYS, NODES, strict=True)}
    near = {k: {b if a == k else a for a, b in RELS if k in (a, b)} for k in KEYS}
    out, seen = set(), set()

    def held(x, y):
        s, u = sorted((content(x), content(y)), key=len)
        short = x if len(content(x)) < len(content(y)) else y
        return len(s) != len(u) and len(s) >= 2 and len(short) >= 3 and s < u

    def score(a, b, windowed):
        a, b = sorted((a, b))
        x, y = value[a][1], value[b][1]
        s, u = tok(x), tok(y)
        overlap = 2 * len(s & u) / (len(s) + len(u)) if s or u else 0.0
        jw = jaro_winkler_of(x, y)
        alike = windowed and jw >= 0.9 and (jw >= 0.95 or overlap >= 0.5)
        if alike or held(x, y):
            both = near[a] | near[b]
            out.add((a, b, "jaro_winkler_0.90" if alike else "token_containment", round(jw, 6), round(overlap, 6), round(len(near[a] & near[b]) / len(both), 6) if both else 0.0))

    for t in "PQR":
        rows = sorted((value[k][1], k) for k in KEYS if value[k][0] == t and value[k][1])
        for i, (_, a) in enumerate(rows):
            for _, b in rows[i + 1 : i + 5]:
                pair = tuple(sorted((a, b)))
                if pair not in seen and (focus is None or a in focus or b in focus):
                    score(a, b, True)
                seen.add(pair)
        for (_, a), (_, b) in combinations(rows, 2):
            if focus is None and a != b and tuple(sorted((a, b))) not in seen:
                score(a, b, False)
    return out


def frames(spark):
    nodes = spark.createDataFrame([(k, t, v, "run1", "v1", i) for i, (k, (t, v)) in enumerate(zip(KEYS, NODES, strict=True))], SCHEMA)
    return nodes, spark.createDataFrame([(f"{a}>{b}", a, b) for a, b in RELS], "dedupe_key string, start_dedupe_key string, end_dedupe_key string")


def test_probable_duplicates(spark):
    nodes, rels = frames(spark)
    got = G.probable_duplicates(nodes, rels).collect()
    found = {(x.key_a, x.key_b, x.method, x.similarity, x.overlap, x.context) for x in got}
    assert len(got) == len(found) == len({x.candidate_id for x in got})
    assert found == plain() and ("P|4", "P|4", "jaro_winkler_0.90", 1.0, 1.0, 1.0) in found
    typed = {(x.key_a, x.key_b) for x in G.probable_duplicates(nodes, rels, ["Q"]).collect()}
    assert typed == {(a, b) for a, b, *_ in plain() if a.startswith("Q")}


def test_probable_duplicates_in_scope(spark):
    nodes, rels = frames(spark)
    focus = spark.createDataFrame([("P|4",), ("Q|7",), (None,)], "dedupe_key string")
    got = {(x.key_a, x.key_b, x.method, x.similarity, x.overlap, x.context) for x in G.probable_pairs(nodes, rels, focus=focus).collect()}
    assert got == plain({"P|4", "Q|7"})


def test_empty(spark):
    nodes = spark.createDataFrame([], SCHEMA)
    rels = spark.createDataFrame([], "dedupe_key string, start_dedupe_key string, end_dedupe_key string")
    assert G.probable_duplicates(nodes, rels).count() == 0


def test_token_pairs_plain(spark):
    """Against all pairs of two sets of tokens, with values longer than those whose pairs are looked under."""
    rng = random.Random(9)
    words_ = [f"w{i}" for i in range(30)]
    values = [" ".join(rng.sample(words_, rng.choice([1, 2, 2, 3, 5]))) for _ in range(150)] + [" ".join(rng.sample(words_, 3) + [f"x{i}y{k}" for k in range(40)]) for i in range(10)]
    rows = spark.createDataFrame([(f"k{i:03}", "T", v, "r", "v", i) for i, v in enumerate(values)], SCHEMA)
    sets = {f"k{i:03}": set(v.split()) for i, v in enumerate(values)}
    want = {(min(a, b), max(a, b)) for a, s in sets.items() for b, t in sets.items() if len(s) >= 2 and len(s) < len(t) and s <= t}
    got = [(r.key_a, r.key_b) for r in G.token_pairs(rows).collect()]
    assert set(got) == want and len(got) == len(want)


def test_token_pairs_of_common_words(spark):
    """Two words that many names have, each with other partners: a name meets only those that hold both."""
    names = [f"red item{i}" for i in range(300)] + [f"bolt part{i}" for i in range(300)] + ["red bolt", "red bolt m4"]
    rows = spark.createDataFrame([(f"k{i}", "T", v, "r", "v", i) for i, v in enumerate(names)], SCHEMA)
    found = G.token_pairs(rows)
    assert [(r.key_a, r.key_b) for r in found.collect()] == [("k600", "k601")]
