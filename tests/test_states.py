"""Streams carry state on over batches and restarts: the same state whatever the split, and keys that expire."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_machine import STATE, plain_fold, some_events

from graphweave.plans.snapshots import Snapshots
from graphweave.streaming import states

START = datetime(2024, 1, 1)


def test_proposals(spark, tmp_path):
    events, known = some_events(200)
    events.sort(key=lambda e: e[1])
    proposals = spark.createDataFrame(known, STATE)
    moves = lambda df: df.select("proposal_id", "seq", "wanted")
    put = lambda rows, name: spark.createDataFrame(rows, "proposal_id long, seq long, wanted string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}")
    want = plain_fold(events, known)
    put(events[:150], "a.parquet")
    run = lambda: states.proposal_stream(spark, f"file://{tmp_path}/in", "*.parquet", f"file://{tmp_path}/state", proposals, moves, 1)
    run()
    put(events[150:], "b.parquet")
    got = run()
    assert Counter(map(tuple, got["states"].collect())) == want[0] and Counter(map(tuple, got["steps"].collect())) == want[1]
    assert Counter(map(tuple, run()["states"].collect())) == want[0] and Snapshots(spark, f"file://{tmp_path}/state").version().number == 1


def test_keys_expire(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(40)}", f"v{i}", START + timedelta(seconds=i + rng.randrange(-30, 30)), float(rng.choice([5, 60, 600]))) for i in range(500)]
    schema = "key string, value string, set_at timestamp, ttl_s double"
    for n, (a, b) in enumerate([(0, 120), (120, 121), (121, 400), (400, 500)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}.parquet")
        got = states.expiring_stream(spark, f"file://{tmp_path}/in", "*.parquet", f"file://{tmp_path}/state", lambda df: df)
        now = max(r[2] for r in rows[:b])
        last = {}
        for r in sorted(rows[:b], key=lambda r: (r[2], r[1])):
            last[r[0]] = r
        want = {k: (r[1], r[2]) for k, r in last.items() if r[2] + timedelta(seconds=r[3]) > now}
        assert {r.key: (r.value, r.set_at) for r in got["keys"].collect()} == want and got["clock"].first().now == now
    asked = spark.createDataFrame([(k, now + timedelta(seconds=s)) for k in ("k1", "k2", "none") for s in (0, 30, 700)], "key string, at timestamp")
    for r in states.looked_up(asked, got["keys"]).collect():
        held = last.get(r.key) if r.key in want else None
        left = held and (held[2] + timedelta(seconds=held[3]) - r.at).total_seconds()
        assert (r.outcome, r.value, r.seconds_left) == (("unknown", None, None) if held is None else ("found", held[1], -(-left // 1)) if left > 0 else ("expired", None, None))
