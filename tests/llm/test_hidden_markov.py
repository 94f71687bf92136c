"""Language-model scoring against plain sums, enumerated state paths and plain recursions."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import ascii_low, words
from pyspark.sql import functions as F

from graphweave.llm import hidden_markov as lm

SCHEMA = "doc_id long, text string"


def some_model(rng, states, symbols):
    draw = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return lm.Model(draw(2, states), draw(states, states), draw(states, symbols).T.copy())


def paths_likelihood(model, start, seq):
    """Summed over all sequences of states."""
    total = 0.0
    for path in itertools.product(range(len(model.move)), repeat=len(seq)):
        p = model.start[start, path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[s, b]
        total += p
    return total


def plain_counts(model, windows):
    """Expected counts by summing over all sequences of states of each window (kind, symbols)."""
    k = len(model.move)
    start, move, emit = np.zeros((2, k)), np.zeros((k, k)), np.zeros(model.emit.shape)
    for kind, seq in windows:
        whole = paths_likelihood(model, kind, seq)
        for path in itertools.product(range(k), repeat=len(seq)):
            p = model.start[kind, path[0]] * model.emit[seq[0], path[0]] / whole
            for a, b, s in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[s, b]
            start[kind, path[0]] += p
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p
            for s, q in zip(seq, path, strict=True):
                emit[s, q] += p
    return start, move, emit


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    model = some_model(rng, 3, 5)
    lengths = np.array([1, 4, 7, 2, 4, 1, 6])
    symbols = rng.integers(0, 5, lengths.sum())
    got, at = lm.forward(model, symbols, lengths), 0
    for log, n in zip(got, lengths, strict=True):
        assert log == pytest.approx(math.log(paths_likelihood(model, 0, symbols[at : at + n].tolist())), abs=1e-10)
        at += n
    assert lm.forward(model, np.zeros(0, int), np.zeros(0, int)).shape == (0,)
    long = rng.integers(0, 5, 5000)  # far below the range of a double
    now, log = model.start[0] * model.emit[long[0]], 0.0
    for s in long[1:]:
        log += math.log(now.sum())
        now = now / now.sum() @ model.move * model.emit[s]
    assert lm.forward(model, long, np.array([5000]))[0] == pytest.approx(log + math.log(now.sum()), rel=1e-12)


def test_baum_welch_counts(monkeypatch):
    rng = np.random.default_rng(3)
    model = some_model(rng, 3, 4)
    lengths = np.array([3, 9, 1, 5, 4])
    symbols = rng.integers(0, 4, lengths.sum())
    first, length, kind = lm.windows(lengths, 4)
    cut = [(int(k), symbols[a : a + n].tolist()) for a, n, k in zip(first, length, kind, strict=True)]
    assert [n for _, n in enumerate(length)] == [3, 4, 4, 1, 1, 4, 1, 4] and kind.tolist() == [0, 0, 1, 1, 0, 0, 1, 0]
    want = plain_counts(model, cut)
    for block in (1, 3, 4096):
        monkeypatch.setattr(lm, "BLOCK", block)
        *got, log = lm.expected(model, symbols, first, length, kind)
        for x, y in zip(got, want, strict=True):
            assert np.abs(x - y).max() < 1e-12
        assert log == pytest.approx(sum(math.log(paths_likelihood(model, k, s)) for k, s in cut))


def corpus(n=160, seed=1):
    """Two ways to write, which a model with states tells apart; null, empty and repeated rows; a long text."""
    rng = np.random.default_rng(seed)
    kinds = [[f"{p}{i}" for i in range(30)] for p in ("al", "Zo")]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(kinds[i % 2], rng.integers(1, 60)).tolist())
        rows.append((i, text.upper() if i % 5 == 0 else f"{text}\tonly{i}" if i % 3 == 0 else text))
    return [*rows, (None, rows[3][1]), (7, rows[7][1]), (500, None), (501, ""), (502, " \n\t "), (503, "new words Nobody learned é"), (504, " ".join((kinds[0] + kinds[1]) * 100))]


def plain_base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of each row."""
    tokens = [[*words(ascii_low(t)), ""] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    log = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(d, h, len(t), sum(count[w] > 0 for w in t), n, sum(map(log, t))) for (d, _), t, h in zip(rows, tokens, held, strict=True)]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize(("own_share", "chunk"), [(1 << 16, 16 << 20), (50, 2000), (1, 500)])
def test_scores(spark, own_share, chunk):
    """Whatever has a symbol of its own and however the corpus is cut, base scores are the plain ones."""
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("chunk", "held_out", "words", "part", "key", "base")}).repartition(3)
    got = sorted((tuple(r) for r in lm.lm_scores(frame, 3, 4, own_share=own_share, chunk_bytes=chunk).collect()), key=key)
    want = sorted(plain_base(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-9)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)
    held = [r for r in got if r[1] and r[3] > 5]
    assert held
    if own_share > 50:  # states tell the two ways apart, which counts of words can't
        assert sum(r[6] for r in held) > sum(r[5] for r in held) + 2 * len(held)


def test_score_is_the_models(spark):
    """Each score is the forward recursion's likelihood of the symbols and the words' chances in their classes, in plain Python."""
    rows = corpus(60)
    symbols, vocab = lm.symbol_chunks(spark.createDataFrame(rows, SCHEMA).coalesce(1), own_share=70)
    model, logs = lm.learned(symbols, vocab, 3, 5)
    assert all(b > a for a, b in itertools.pairwise(logs))
    held = {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 10 == 0}
    tokens = {d: [*words(ascii_low(t)), ""] for d, t in rows}
    count = Counter(w for d, t in rows if d not in held for w in [*words(ascii_low(t)), ""])
    n = sum(count.values())
    assert (vocab.n, vocab.v, len(vocab.own)) == (n, len(count), sum(70 * c >= n for c in count.values())) and 0 < len(vocab.own) < len(count)

    def class_of(w):
        b = w.encode() or b"\0"  # the end has class 0
        return ((b[-1] << 8 | (b[-2] if len(b) > 1 else 0)) * 40503 & 0xFFFF) % lm.CLASSES

    mass = Counter()
    for w, c in count.items():
        if 70 * c < n:
            mass[class_of(w)] += c + 0.1
    chunk = [r.asDict() for r in symbols.collect()]
    codes = np.concatenate([lm.numbers(r["symbols"]) for r in chunk])
    lengths = np.concatenate([np.frombuffer(r["lengths"], np.uint32) for r in chunk]).tolist()
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in chunk]).tolist()
    names, at = {}, 0  # symbols are the same for the same frequent word, and those of classes for the others
    told = spark.sparkContext.broadcast(model)
    got = [(r.doc_id, r.score) for r in symbols.select(*lm.SCORED).mapInArrow(lm.scoring(told), lm.SCORES).collect()]
    for (doc_id, score), number, k in zip(got, ids, lengths, strict=True):
        seq = codes[at : at + k].tolist()
        at += k
        own = tokens[doc_id]
        assert doc_id in (None, number) and len(own) == k
        for w, s in zip(own, seq, strict=True):
            assert names.setdefault(w if 70 * count[w] >= n else class_of(w), s) == s
        rare = sum(math.log10((count[w] + 0.1) / (mass[class_of(w)] + 0.1)) for w in own if 70 * count[w] < n)
        now = model.start[0] * model.emit[seq[0]]
        for s in seq[1:]:
            now = now @ model.move * model.emit[s]
        if now.sum() > 0:
            assert score == pytest.approx(math.log10(now.sum()) + rare, abs=1e-9)


def test_chances_add_up(spark):
    """The chances of all next words, an unknown one of each class included, are 1."""
    symbols, vocab = lm.symbol_chunks(spark.createDataFrame(corpus(60), SCHEMA), own_share=70)
    model, _ = lm.learned(symbols, vocab, 3, 2)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.start.sum(1), 1)
    assert vocab.share.sum() == pytest.approx(1) and (vocab.mass >= 0.1 - 1e-12).all()


def test_runs_are_equal(spark):
    rows = spark.createDataFrame(corpus(80), SCHEMA).repartition(3, "doc_id")
    a, b = (sorted(map(tuple, lm.lm_scores(rows, 2, 2).collect()), key=key) for _ in range(2))
    assert a == b


def test_small(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = lm.lm_scores(spark.createDataFrame([(i, "a b") for i in held], SCHEMA)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) and math.isfinite(r.score) for r in got) and len(got) == len(held)
    one = lm.lm_scores(spark.createDataFrame([(1, None)], SCHEMA)).collect()[0]
    assert (one.n_tokens, one.n_known, one.train_tokens) == (1, 1, 1)
