"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its letters' 3- and 4-byte grams, word ends included, hashed to 2**BITS rows of an
embedding table. Their average goes through a linear softmax. Since both steps are linear, scoring uses the
product of table and softmax weights: one number per gram and language. A temperature fitted on a part of
the sample that was not trained on calibrates the scores, and a rejection threshold on them marks
predictions that are likelier wrong than the accepted error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import bounded_sample, documents
from graphweave.llm.toxicity import held_out

BITS, WIDTH = 14, 12
#: Rows learned from, at most about this many, chosen by a hash of doc_id (their gram counts are bounded by 2**BITS each).
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
#: The share of accepted predictions that may be wrong.
ERROR = 0.01
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each gram that lies in one text and holds a letter or other non-ASCII byte."""
    off, raw = H.buffers(batch.column("text"))
    b = _FOLD[raw]
    texts = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(off))
    if len(b) < 4:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    c = b.astype(np.uint32)
    three = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    four = (three[:-1] << np.uint32(8)) | c[3:]
    shift = np.uint32(32 - BITS)
    out_t, out_g = [], []
    for g, n, salt in ((three, 3, 2654435761), (four, 4, 2246822519)):
        ok = (texts[: len(g)] == texts[n - 1 :]) & (b[1 : len(g) + 1] != 32)
        out_t.append(texts[: len(g)][ok])
        out_g.append(((g[ok] * np.uint32(salt)) >> shift).astype(np.int32))
    return np.concatenate(out_t), np.concatenate(out_g)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in H.pieces(whole, most=1 << 20):
            text, gram = grams(batch)
            key, n = np.unique(text.astype(np.int64) << BITS | gram, return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(batch.num_rows + 1))
            g = (key & ((1 << BITS) - 1)).astype(np.uint16)
            n = n.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_hash", "lang")),
                 pa.array([g[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array([n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["doc_id", "text_hash", "lang", "grams", "counts"],
            )


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 6, rate: float = 0.8) -> tuple[np.ndarray, float, float]:
    """The table of gram scores per class, the temperature and the rejection threshold."""
    rng = np.random.Generator(np.random.PCG64(2))
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    out = np.zeros((WIDTH, n_classes))
    cut = max(1, len(rows) * 4 // 5)
    steps, done = epochs * cut, 0
    for _ in range(epochs):
        for i in rng.permutation(cut):
            g, n, label = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(g):
                continue
            share = (n / n.sum())[:, None]
            mean = (table[g] * share).sum(0)
            d = softmax(mean @ out)
            d[label] -= 1
            back = out @ d
            out -= lr * np.outer(mean, d)
            table[g] -= lr * share * back * 10
    score = table @ out
    rest = [r for r in rows[cut:] if len(r[0])] or [r for r in rows if len(r[0])]
    logits = np.array([(score[g] * (n / n.sum())[:, None]).sum(0) for g, n, _ in rest]).reshape(-1, n_classes)
    labels = np.array([r[2] for r in rest], int)
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss) if len(labels) else 1.0
    sure = softmax(logits / temperature)
    top, right = sure.max(1), sure.argmax(1) == labels
    threshold = next((t for t in np.linspace(0, 0.99, 100) if (top >= t).any() and 1 - right[top >= t].mean() <= ERROR), 0.99)
    return score, float(temperature), float(threshold)


def train(docs: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float, float]:
    """Languages in order, and what fit gives, from about `most` rows outside the held-out fold (bounded_sample says which)."""
    known = documents(docs, "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1) & F.col("text").rlike(r"\p{L}")
    )
    chosen = bounded_sample(known, most / max(1, known.count()), most, most_bytes).select("doc_id", "text_hash", "lang", "text")
    rows = chosen.mapInArrow(count_rows, "doc_id long, text_hash long, lang string, grams binary, counts binary")
    got = rows.toPandas().sort_values(["doc_id", "text_hash"])
    langs = sorted(set(got.lang))
    if not langs:
        return ["und"], np.zeros((1 << BITS, 1)), 1.0, 0.0
    rows = [(np.frombuffer(g, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32).astype(float), langs.index(x)) for g, n, x in zip(got.grams, got.counts, got.lang, strict=True)]
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
    return langs, *fit([rows[i] for i in order], len(langs))


def scorer(model):  # noqa: ANN001, ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, score, temperature, threshold = model.value
        for whole in batches:
            for batch in H.pieces(whole, most=2 << 20):
                text, gram = grams(batch)
                n = np.maximum(np.bincount(text, minlength=batch.num_rows), 1)
                logits = np.stack([np.bincount(text, score[:, k][gram], batch.num_rows) / n for k in range(len(langs))], 1)
                p = softmax(logits / temperature)
                best, top = p.argmax(1), p.max(1)
                letter = np.asarray(pc.match_substring_regex(batch.column("text").fill_null(""), r"\p{L}"))
                pred = np.where(letter, np.array(langs, object)[best], "und")
                top = np.where(letter, top, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(top), pa.array(top < threshold)], names=["doc_id", "lang_pred", "score", "rejected"]
                )

    return run


def language_id(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per document.

    Predictions come from the whole text alone. A text that is null, empty or without a letter is `und`
    with score 0. rejected marks scores under the calibrated threshold. Rows that repeat get equal
    results; a null doc_id is scored and never held out; a null lang is not learned from. An empty table
    gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, most))  # 2**BITS numbers per language
    scored = documents(docs).mapInArrow(scorer(model), "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
