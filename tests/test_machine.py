"""Events folded in order, calls in cooldown, batches given back to their inputs, numbers and names as plain Python has them."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.functions.names import title_case
from graphweave.functions.numbers import round_exact
from graphweave.functions.replies import decode, reply_error, strip_code_fence
from graphweave.operators import batches, machine
from graphweave.plans.tables import carried
from graphweave.sources import parsing

EVENT, STATE = "proposal_id long, seq long, wanted string", "proposal_id long, state string, last_seq long"


def plain_fold(events, states):
    states, out = {p: [s, n] for p, s, n in states}, []
    for p, seq, wanted in sorted(events):
        if p not in states:
            out.append((p, seq, None, wanted, "unknown"))
            continue
        state, last = states[p]
        ok = (state, wanted) in machine.ALLOWED
        out.append((p, seq, state, wanted, "moved" if ok else "illegal"))
        states[p] = [wanted if ok else state, seq]
    return Counter((p, *s) for p, s in states.items()), Counter(out)


def some_events(n=900):
    rng = random.Random(3)
    wanted = ["approved", "rejected", "deferred", "excluded", "pending", "pending", "pending"]  # an approval or a rejection ends most ways
    rows = [(1, i, rng.choice(wanted[2:])) for i in range(n)] + [(rng.randrange(2, 60), n + i, rng.choice(wanted)) for i in range(n)]
    return [*rows, (1, n, "approved"), (1, n + 1, "executed"), (1, n + 2, "pending"), (99, 5, "approved")], [(p, "pending" if p % 5 else "approved", None) for p in range(1, 60)]


def test_fold(spark):
    events, states = some_events()
    after, steps = machine.fold(spark.createDataFrame(events, EVENT).repartition(3), spark.createDataFrame(states, STATE))
    want = plain_fold(events, states)
    assert Counter(map(tuple, after.collect())) == want[0] and Counter(map(tuple, steps.collect())) == want[1]
    assert {r[-1] for r in want[1]} == {"moved", "illegal", "unknown"} and want[0][(1, "executed", 902)] == 1


@pytest.mark.parametrize("cuts", [[450], [100, 101, 1500]])
def test_fold_in_batches(spark, cuts):
    """Any split along the order gives the same; what comes late is passed over and said so."""
    events, states = some_events()
    whole, now, seen = plain_fold(events, states), spark.createDataFrame(states, STATE), Counter()
    for a, b in zip([0, *cuts], [*cuts, 10**6], strict=True):
        now, steps = machine.fold(spark.createDataFrame([e for e in events if a <= e[1] < b], EVENT), now)
        seen += Counter(map(tuple, steps.collect()))
    assert Counter(map(tuple, now.collect())) == whole[0] and seen == whole[1]
    again, steps = machine.fold(spark.createDataFrame([(1, 5, "pending")], EVENT), now)
    assert [tuple(r) for r in steps.collect()] == [(1, 5, "executed", "pending", "late")] and Counter(map(tuple, again.collect())) == whole[0]


def test_carried_and_guarded(spark):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(4000) / 4)
    calls = [(i, rng.choice(["hot", "hot", "cold", None]), at()) for i in range(400)]
    runs = [(rng.choice(["hot", "cold"]), at()) for _ in range(12)]
    frames = spark.createDataFrame(calls, "call_id long, run_id string, at timestamp"), spark.createDataFrame(runs, "run_id string, at timestamp")
    got = machine.guarded(*frames, spark.createDataFrame([("hot",)], "run_id string"), 30).collect()
    want = {}
    for i, run, t in calls:
        before = [x for r, x in runs if r == run and x <= t]
        left = 30 - (t - max(before)).total_seconds() if before else 0
        want[i] = ("execution_cooldown", int(left) + 1) if left > 0 else ("ok" if run == "hot" else "schema_not_locked", None)
    assert {r.call_id: (r.outcome, r.retry_after) for r in got} == want and len({w[0] for w in want.values()}) == 3
    rows = spark.createDataFrame([("a", i, i if i % 10 == 0 and i else None) for i in range(100)], "k string, i long, v long")
    assert [r.last for r in carried(rows, ["k"], ["i"], "v").orderBy("i").collect()] == [i // 10 * 10 or None for i in range(100)]


ITEM = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("note", T.StringType(), True)])


def test_rekeyed(spark):
    inputs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "c"), (2, "a"), (3, "x"), (4, "y")], "batch long, id string")
    replies = spark.createDataFrame([
        (1, '```json\n{"results": [{"id": "a", "score": 0.1}, {"id": "c", "score": 2.0}, {"id": "a", "score": 0.7, "note": "n"}, {"id": "z", "score": 1}]}\n```'),
        (2, '{"results": [{"id": "a", "score": "0.5"}]}'), (3, '{"results": []}'),
    ], "batch long, reply string")
    out, unknown = batches.rekeyed(inputs, replies, ITEM, "id", F.col("item.score") <= 1, F.struct(F.col("id"), F.lit(0.0), F.lit("fallback")))
    got = sorted((r.batch, r.id, r.outcome, r.item.score, r.item.note) for r in out.collect())
    assert got == [
        (1, "a", "taken", 0.7, "n"), (1, "b", "missing", 0.0, "fallback"), (1, "c", "rejected", 0.0, "fallback"), (1, "c", "rejected", 0.0, "fallback"),
        (2, "a", "refused", 0.0, "fallback"), (3, "x", "missing", 0.0, "fallback"), (4, "y", "refused", 0.0, "fallback"),
    ]
    assert [tuple(r) for r in unknown.collect()] == [(1, "z")]
    assert [r[0] for r in out.select(batches.routed(F.col("item.score"))).distinct().orderBy(F.lit(1)).collect()] in (["propose", "retrieve"], ["retrieve", "propose"])


OK = '{"a": "s", "n": 3, "x": 1.5, "items": [{"k": "v"}]}'
ASKED = T.StructType([
    T.StructField("a", T.StringType(), False), T.StructField("n", T.LongType(), False), T.StructField("x", T.DoubleType(), True),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("k", T.StringType(), False)])), False)])


def test_replies(spark):
    cases = {
        OK: None, f"```json\n{OK}\n```": None, f"```\n{OK}\n``` \n": None, f" \n{OK}\t": None, OK.replace('"x": 1.5, ', ""): None, OK.replace("1.5", "null"): None, OK.replace("1.5", "2"): None,
        OK.replace('[{"k": "v"}]', "[]"): None, OK[:-3]: "json", OK + "x": "json", OK + "]": "json", OK + "}": "json", f"{OK}, {OK}": "json", OK + ', "w": 1': "json", "": "json", "```": "json",
        OK.replace('"a"', '"n"'): "json", OK.replace("3", '"3"'): "fields", OK.replace("3", "3.5"): "fields", OK.replace('"s"', "null"): "fields", OK[:-1] + ', "more": 1}': "fields",
        OK.replace('"v"', '"v", "z": 1'): "fields", OK.replace('"v"', "1"): "fields", OK.replace('[{"k": "v"}]', "{}"): "fields", OK.replace('{"k": "v"}', "null"): "fields", "[]": "fields", "3": "fields",
    }
    rows = spark.createDataFrame([(i, r) for i, r in enumerate([*cases, None])], "i long, r string")
    got = rows.select("i", reply_error(F.col("r"), ASKED).alias("error"), decode(F.col("r"), ASKED).alias("d")).orderBy("i").collect()
    assert [r.error for r in got] == [*cases.values(), "json"] and all((r.d is None) == (r.error is not None) for r in got)
    assert got[0].d.asDict(True) == {"a": "s", "n": 3, "x": 1.5, "items": [{"k": "v"}]} and got[6].d.x == 2.0


def plain_fence(text):
    clean = text.strip()
    if clean.startswith("```"):
        first = clean.find("\n")
        clean = clean[first + 1 :] if first != -1 else clean
        if clean.rstrip().endswith("```"):
            clean = clean.rstrip()[:-3].rstrip()
    return clean


def test_strip_code_fence(spark):
    texts = ["a", " a ", "```\na\n```", "```json\na\n\n``` ", "```json\na", "``` a ```", "```", "``````", "a\n```", "```x\n```", " ```\nb \n```\n", "```\n```\n```"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(strip_code_fence(F.col("t"))).collect()]
    assert got == [plain_fence(t) for t in texts]


def test_round_exact(spark):
    rng = random.Random(1)
    xs = [2.675, 0.5, 1.5, 2.5, -2.5, 1e-7, 0.1234565, 1e15, 1e300, float("inf"), None, *[rng.random() for _ in range(100_000)], *[rng.uniform(-1e9, 1e9) for _ in range(5000)], *[rng.randrange(10**7) / 10**6 + 5e-7 for _ in range(5000)], *[rng.randrange(2**40) / 2**20 for _ in range(5000)]]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 2, 4, 6):
        for x, y in frame.select("x", round_exact(F.col("x"), digits)).collect():
            assert y == (x if x is None or x == float("inf") else round(x, digits)), (x, digits)


def test_title_case(spark):
    rng = random.Random(2)
    texts = ["o'neil", "mc-donald", " élan vital ÉCOLE ", "ßeta ǆur ΣΑΣ", "don’t 3rd x2y", "", "中文abc", "ﬁn", *["".join(rng.choice("abcXYZ éÖß'-. 中1ñΣλЖд") for _ in range(12)) for _ in range(3000)]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", title_case(F.col("t")).alias("y")).collect()
    assert [(r.t, r.y) for r in got if r.y != r.t.strip().title()] == []


def test_parse_chain(spark):
    def strict(content, name):
        if b"<article>" not in content:
            raise ValueError(f"no article in {name}")
        return content.split(b"<article>")[1].split(b"</article>")[0].decode()

    files = spark.createDataFrame([(1, "a.html", b"<article>text</article>"), (2, "b.html", b"plain"), (3, "c", b"\xff\xe9"), (4, "d", b""), (5, "e", None), (6, "f", b"<article> </article>")], "doc_id long, name string, content binary")
    tiers = [("strict", strict), ("raw_text", parsing.raw_text)]
    got = {r.doc_id: (r.text, r.parser, r.tier, [tuple(a) for a in r.attempts], r.error) for r in parsing.parse_chain(files, tiers).collect()}
    assert got[1] == ("text", "strict", 0, [], None) and got[2] == ("plain", "raw_text", 1, [("strict", "no article in b.html")], None) and got[3][:3] == ("ÿé", "raw_text", 1)
    assert got[4] == got[5][:0] + (None, None, None, [("strict", "no article in d"), ("raw_text", "empty_text")], "all_parsers_failed")
    assert got[5][4] == "all_parsers_failed" and got[6] == ("<article> </article>", "raw_text", 1, [("strict", "empty_text")], None)
    assert {(r.doc_id, r.error) for r in parsing.parse_chain(files, []).collect()} == {(i, "no_parsers_enabled") for i in range(1, 7)}
    assert {tuple(r) for r in parsing.parser_counts(parsing.parse_chain(files, tiers)).collect()} == {("strict", 1, 0), ("raw_text", 3, 3), (None, 2, 2)}
