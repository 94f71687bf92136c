"""The source audit and the conversation trie against plain loops, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import ascii_low, words
from pyspark.sql import functions as F

from graphweave.llm import conversation_trie as trie
from graphweave.llm import source_divergence as audit

DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, min_docs, top):
    """rows: text, lang, source."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_low(t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = Counter(t for f, r in zip(found, rows, strict=True) if r[1] == lang for t in set(f))
        kept = {t for t, n in docs.items() if n >= min_docs}
        groups = {r[2]: Counter() for r in rows if r[1] == lang}
        for f, r in zip(found, rows, strict=True):
            if r[1] == lang:
                groups[r[2]].update(t for t in f if t in kept)
        whole = sum(groups.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        shares, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s in groups:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in groups if o != s]
            own = [(t, shares[s][t] - q[t]) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def test_audit(spark):
    rng = np.random.default_rng(3)
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "né", "ne"]
    rows = []
    for i in range(120):
        text = ". ".join(rng.choice(names[: 20 + 15 * (i % 4)], rng.integers(1, 40)).tolist())
        rows.append((text.upper() if i % 7 == 0 else text, ("en", "de", None)[i % 3], ("a", "b", "c", None)[(i // 3) % 4 if i % 2 else 0]))
    rows += [(None, "en", "a"), ("", "en", "none of its own"), ("only here", "xx", "a"), ("and here", "xx", "b"), (" ".join(names * 3000), "de", "b"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i % 50, *r) for i, r in enumerate(rows)], DOCS).withColumns({c: F.lit(1) for c in ("term", "no", "value", "n", "v", "vector")})
    for min_docs in (1, 9):
        got = sorted(map(tuple, audit.source_divergence(docs, min_docs, 5).collect()))
        assert got == plain_audit(rows, min_docs, 5)
    assert audit.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_run_lengths_and_large_numbers():
    """Runs of a column, and sums beyond 64 bits on the way, against a value per term."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        rows, n = int(rng.integers(1, 30)), int(rng.integers(2, 5))
        counts = rng.choice([0, 0, 1, 7, 10**13], (n, rows))
        length, totals, v = rng.integers(1, 1000, rows), [int(x) + 10**14 for x in counts.sum(1)], 10**6
        position, row = np.nonzero(counts)
        got = audit.pair_sums(position, row, counts[position, row], length, totals, v)
        p = [[1 + 10**9 * (int(c) + 5) // (t + 5 * v) for c in column] for column, t in zip(counts, totals, strict=True)]
        for a in range(n):
            for b in range(a + 1, n):
                assert got[a, b] == sum(abs(x - y) * int(k) for x, y, k in zip(p[a], p[b], length, strict=True))
        first, values = audit.runs(*np.stack([row, counts[position, row]])[:, position == 0], rows)
        assert (values[1:] != values[:-1]).all() and first[0] == 0


def test_audit_plan_has_few_runs(spark):
    """In the order of the vectors a column of zeros and ones is two runs."""
    kept = spark.createDataFrame([("en", f"t{i}", 1, [("ab"[i % 2], 1)]) for i in range(100)], "lang string, term string, total long, by_source array<struct<source:string,count:long>>")
    groups = spark.createDataFrame([("en", "a", 50, 100, 100, 0), ("en", "b", 50, 100, 100, 1)], "lang string, source string, n long, v long, lang_n long, no int")
    p = [1 + 10**9 * (c + 5) // 550 for c in (0, 1)]
    assert [tuple(r) for r in audit.pair_values(kept, groups).collect()] == [("en", 0, 1, 100 * (p[1] - p[0]))]


def plain_trie(rows):
    """rows: conv_id, turn, role, text."""
    own = {}
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        if c is None:
            rebuilt[c] = turns
            continue
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    least = {k: min((c for c in m if c is not None), default=None) for k, m in members.items()}
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = sorted(c for c in m if c is not None and len(rebuilt[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below if x)
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(m), children[k], sum(not children[x] for x in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def conversations(seed, n=150):
    """Few different turns, so that paths are shared; ids with gaps, also negative and null ones; copies of one conversation."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*rng.choice(np.arange(-60, 300), n, replace=False).tolist(), None]:
        for turn in range(int(rng.integers(1, 7))):
            text = "the same start" if rng.random() < 0.6 else f"say {rng.integers(0, 3)}\tand more" if rng.random() < 0.8 else None
            rows.append((c, None if rng.random() < 0.05 else turn, ("user", "bot", None)[turn % 3], text))
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(60) for t in range(5)]
    rows += [rows[0], rows[-1], (2000, 0, "user", "x " * 50_000), *[(2001, t, "user", f"long {t}") for t in range(300)], *[(2041, t, "user", f"long {t}") for t in range(300)]]
    return rows


@pytest.mark.parametrize("shard", [1, 3, 16, 4096])
def test_trie(spark, shard):
    rows = conversations(shard)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("path", "words", "key", "depth", "none")})
    got = trie.conversation_trie(frame, shard).collect()
    assert Counter(map(tuple, got)) == plain_trie(rows)


def test_trie_small(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "a"), (21, 0, None, None), (40, None, "user", None)]
    assert Counter(map(tuple, trie.conversation_trie(spark.createDataFrame(rows, schema)).collect())) == plain_trie(rows)
