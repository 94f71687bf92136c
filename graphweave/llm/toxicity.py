"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words, neighbouring pairs and pairs with one word between, hashed to
2**BITS. A feature counts by presence, however often it occurs, and texts are weighed by what share of
their features each is. Per-coordinate learning rates and L1 sparsity leave few weights, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import bounded_sample, documents

BITS = 18
#: Labelled rows learned from, about this many and twice as many at most, drawn by a hash of doc_id; and how many bytes of
#: text they have together, which bounds what the driver holds.
SAMPLE, SAMPLE_BYTES = 12_000, 64 << 20
THRESHOLD = 0.3
_MARKS = np.array([35, 36, 37, 38, 42, 44, 46, 33, 63, 58, 59, 34, 39, 40, 41], np.uint8)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of each distinct feature of each text, in that order."""
    off, raw = H.buffers(batch.column("text"))
    raw = raw.copy()
    raw[np.isin(raw, _MARKS)] = 32  # punctuation parts words
    _, _, text, h = H.words(off, raw, lower=True)
    keys = [text.astype(np.uint64) << H.U(BITS) | h >> H.U(64 - BITS)]
    for gap, salt in ((1, 0x51ED27), (2, 0x7F4A7C)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            pair = H.mix(h[:-gap] * H.U(salt * 2 + 1) + h[gap:])
            keys.append(text[gap:][same].astype(np.uint64) << H.U(BITS) | pair[same] >> H.U(64 - BITS))
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> H.U(BITS)).astype(np.int64), (key & H.U((1 << BITS) - 1)).astype(np.int64)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in H.pieces(whole):
            text, feature = features(batch)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            blobs = [feature[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            keep = [batch.column(c) for c in ("doc_id", "text_hash", "label")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(blobs, pa.binary())], names=["doc_id", "text_hash", "label", "features"])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = 4, alpha: float = 0.4, beta: float = 1.0, l1: float = 8.0, l2: float = 0.3) -> np.ndarray:
    """Weights for 2**BITS features, the bias last. Each text's features weigh 1 each."""
    n = (1 << BITS) + 1
    z, g2, w = np.zeros(n), np.zeros(n), np.zeros(n)
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at = np.append(examples[i], n - 1).astype(np.int64)
            zi, ni = z[at], g2[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35)))
            g = p - labels[i]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - step * wi
            g2[at] = ni + g * g
    shrunk = np.abs(z) <= l1
    w[~shrunk] = (np.sign(z) * l1 - z)[~shrunk] / ((beta + np.sqrt(g2))[~shrunk] / alpha + l2)
    return w


def views(column: pa.Array) -> list[np.ndarray]:
    """Each row's numbers, in place; no row is null."""
    _, off, raw = column.buffers()
    cut = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    numbers = np.frombuffer(raw, np.uint32, int(cut[-1])) if raw is not None else np.zeros(0, np.uint32)
    return [numbers[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, fold: tuple[int, int] = (4, 2), most_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights learned from about `most` labelled rows outside the held-out fold (bounded_sample says which), in the order of doc_id
    and text hash.

    Labels that are null are left out; of several labels for a doc_id the largest counts. Without any
    labelled row all weights are 0 and the bias is the least there is, so that nothing is rejected.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *fold))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = bounded_sample(documents(docs).join(known, "doc_id"), most / max(1, known.count()), most, most_bytes)
    rows = chosen.select("doc_id", "text_hash", "label", "text").mapInArrow(feature_rows, "doc_id long, text_hash long, label int, features binary")
    got = rows.toArrow().to_batches()
    if not sum(b.num_rows for b in got):
        return np.append(np.zeros(1 << BITS), -35.0)
    # the features stay in the batches' buffers: a pandas copy would need several times their size
    order = np.lexsort([np.concatenate([np.asarray(b.column(c)) for b in got]) for c in ("text_hash", "doc_id")])
    examples = [x for b in got for x in views(b.column("features"))]
    labelled = np.concatenate([np.asarray(b.column("label")) for b in got])
    return ftrl([examples[i] for i in order], (labelled[order] > 0).astype(float))


def scored(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:  # noqa: ANN001
    """The rows in slices, each with its scores."""
    at, value, bias = weights.value
    dense = np.zeros(1 << BITS)
    dense[at] = value
    for whole in batches:
        for batch in H.pieces(whole):
            text, feature = features(batch)
            total = np.bincount(text, dense[feature], batch.num_rows) + bias
            yield batch, 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def scorer(weights):  # noqa: ANN001, ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(weights, batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def keeper(weights, threshold: float):  # noqa: ANN001, ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(weights, batches):
            yield batch.filter(pa.array(score < threshold))

    return run


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):  # noqa: ANN201
    """The weights that are not 0, broadcast: 2**BITS at most."""
    w = train(docs, labels, most)
    at = np.flatnonzero(w[:-1])
    return docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), w[at], float(w[-1])))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document.

    Scores come from the text alone; null and empty texts have no features and get the bias's score. Rows
    that repeat get equal scores; a null doc_id is scored and never held out. An empty table gives no
    rows; other columns are not read.
    """
    rows = documents(docs).mapInArrow(scorer(learned(docs, labels, most)), "doc_id long, score double")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic.

    Each row is judged by its own text, whatever its doc_id: rows that share one, or have none, stay or go on
    their own. A null text is scored as empty and stays null.
    """
    return docs.mapInArrow(keeper(learned(docs, labels), threshold), docs.schema)
