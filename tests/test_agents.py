"""Indexing in batches, rounds of retrieval, chains of parsers, and replies that are decoded or refused."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.operators import indexing, retrieval
from graphweave.plans.snapshots import Snapshots
from graphweave.plans.tables import numbered

CHUNK = "run_id string, doc_id long, chunk_index long, chunk_id string, locator string, text string"


def test_numbered(spark):
    """Places in one hot key, and in null and small ones, however the ranges fall."""
    rows = [("hot", i * 7 % 1000) for i in range(1000)] + [(None, 3), (None, 1), ("b", 5)]
    got = numbered(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"]).collect()
    want = {("hot", v): v for v in range(1000)} | {(None, 1): 0, (None, 3): 1, ("b", 5): 0}
    assert {(r.k, r.v): r.place for r in got} == want and len(got) == len(rows)


def chunks(spark, n=250, bad=()):
    rows = [(f"r{i % 2}", i // 40, i % 40, f"c{i:04d}", f"p{i}", "bad" if i in bad else None if i % 50 == 3 else f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, CHUNK)


def model():
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("the model is down")
        return [[float(len(t)), 1.0] if t != "text 77" else [1.0] for t in texts]

    return embed


def points(index):
    return {r.chunk_id: (r.run_id, r.doc_id, r.text, tuple(r.vector)) for r in index.read()["points"].collect()}


def errors(index):
    return sorted((r.run_id, r.batch, r.stage, r.first, r.last) for r in index.read()["errors"].collect())


def test_index(spark, tmp_path):
    index, embed = Snapshots(spark, f"file://{tmp_path}/index"), model()
    assert indexing.index_chunks(index, chunks(spark, bad=(40,)), embed, 2, 20).state == "committed"
    # chunk 40 is the 20th of run r0, chunk 77 the 38th of run r1
    assert errors(index) == [("r0", 1, "embedding", 20, 39), ("r1", 1, "upsert", 20, 39)]
    first = points(index)
    gone = {f"c{i:04d}" for i in range(250) if i // 2 // 20 == 1}
    assert set(first) == {f"c{i:04d}" for i in range(250)} - gone and first["c0003"] == ("r1", 0, None, (0.0, 1.0))
    indexing.index_chunks(index, chunks(spark, bad=(40,)), embed, 2, 20)
    assert points(index) == first and errors(index) == [("r0", 1, "embedding", 20, 39), ("r1", 1, "upsert", 20, 39)]
    indexing.index_chunks(index, chunks(spark), embed, 2, 20)
    assert len(points(index)) == 230 and errors(index) == [("r1", 1, "upsert", 20, 39)]
    other = spark.createDataFrame([("r2", 1, 0, "c0001", "p", "moved"), ("r2", 1, 1, "new", "p", "a"), ("r2", 1, 2, "new", "p", "again")], CHUNK)
    indexing.index_chunks(index, other, embed, 2)
    now = points(index)
    assert len(now) == 231 and now["c0001"] == ("r2", 1, "moved", (5.0, 1.0)) and now["new"][2] == "again" and len(errors(index)) == 1
    indexing.index_chunks(index, chunks(spark, 0), embed, 2)
    assert points(index) == now


WEIGHTS = {"supporting": 0.3, "corroborating": 0.15, "conflicting": 0.1}


def plain_rounds(candidates, items, ask, search):
    ends, records = [], []
    for c, base, budget, most in candidates:
        mine = sorted((pos, chunk, kind) for i, chunk, kind, pos in items if i == c)
        kinds, seen, new, used, stop = [k for *_, k in mine], {x for _, x, _ in mine}, 0, 0, "rounds"

        def score():
            total = base
            for k in kinds:  # noqa: B023
                total += WEIGHTS.get(k, 0.0)  # noqa: B023
            return min(1.0, total)

        for number in range(1, (most or 0) + 1):
            if (budget or 0) <= 0:
                stop = "budget"
                break
            query = ask(c, number, len(kinds), budget)
            if query is None:
                stop = "failed"
                break
            used += 1
            if not query.strip():
                records.append((c, number, query, (), budget))
                stop = "voluntary"
                break
            fresh = [x for x in search(query) if x not in seen]
            seen.update(fresh)
            budget = max(0, budget - 500)
            new += len(fresh)
            kinds += ["corroborating"] * len(fresh)
            records.append((c, number, query, tuple(fresh), budget))
            if number == 1 and not fresh:
                stop = "exhausted"
                break
            if score() >= 0.6:
                stop = "sufficient"
                break
        ends.append((c, used, budget or 0, len(kinds), score(), score() >= 0.6, new == 0, stop))
    return Counter(ends), Counter(records)


def test_retrieval_rounds(spark):
    rng = np.random.default_rng(4)
    candidates = [(i, float(rng.choice([0.0, 0.05, 0.3, 0.5, 0.55])), int(rng.choice([0, 300, 900, 2000])), int(rng.integers(0, 5))) for i in range(120)] + [(200, 0.0, None, 3), (201, 0.1, 900, None)]
    items = [(i, f"d{rng.integers(0, 12)}", str(rng.choice([*WEIGHTS, "other"])), pos) for i in range(0, 120, 2) for pos in range(int(rng.integers(0, 4)))]
    items = list({(i, c): (i, c, k, p) for i, c, k, p in items}.values())

    def query(c, number, n, budget):
        return None if (c + number) % 11 == 0 else " " if (c * number) % 13 == 12 else f"q{(c + number * 3) % 7}"

    found = {f"q{k}": [f"d{(k * 2 + j) % 12}" for j in range(k % 4)] for k in range(7)}
    rank = spark.createDataFrame([(q, x, 1.0 - j / 10) for q, xs in found.items() for j, x in enumerate(xs)], "query string, chunk_id string, score double")

    def ask(open_):
        c, r = F.col("candidate_id"), F.col("round")
        text = F.when((c + r) % 11 == 0, F.lit(None)).when((c * r) % 13 == 12, " ").otherwise(F.concat(F.lit("q"), ((c + r * 3) % 7).cast("string")))
        return open_.select("candidate_id", text.alias("query"))

    search = lambda queries: queries.join(rank, "query").select("candidate_id", "chunk_id", "score")
    frame = spark.createDataFrame(candidates, "candidate_id long, baseline double, budget long, max_rounds long")
    given = spark.createDataFrame(items, "candidate_id long, chunk_id string, classification string, pos long")
    ends, records = retrieval.retrieve(frame, given, ask, search, 4)
    want = plain_rounds(candidates, items, query, lambda q: found[q])
    assert Counter(map(tuple, ends.collect())) == want[0]
    assert Counter((r.candidate_id, r.round, r.query, tuple(r.chunk_ids), r.budget_left) for r in records.collect()) == want[1]
    assert {r[-1] for r in want[0]} == {"budget", "failed", "voluntary", "exhausted", "sufficient", "rounds"}


def test_baseline(spark):
    rows = [(0.95, 0.5, 0.5), (0.9, 0.1, 0.49), (0.85, 0.0, 0.0), (0.84, -1.0, 1.0), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double").select(retrieval.baseline(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [0.5 + 0.2 + 0.05, 0.4 + 0.1, 0.3, 0.05, 0.0]
