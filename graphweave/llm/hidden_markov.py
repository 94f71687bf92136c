"""Language-model scoring by a hidden Markov model whose counts come from the whole corpus.

1. Texts become chunks: numbered words, with each chunk's own list of words and how often training documents of the chunk
   have them. Lists are dealt by word, counts are summed over all chunks, and each chunk gets the sums back.
2. A word that makes up 1/OWN of all training tokens has a symbol of its own (there are OWN such words at most, whatever
   the corpus); others share the symbol of a class by their last two bytes, within which a word's chance follows
   from its count. So the model's tables have a fixed size, and no word's chance is cut.
3. Baum-Welch: tasks run scaled forward and backward recursions over all training text, in windows of WINDOW tokens, and
   hand on expected counts per symbol and state, which are summed as whole numbers, so that their order does not matter.
4. The likelihood of a text is that of the scaled forward recursion over the whole text, as one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import documents, materialise
from graphweave.llm.toxicity import held_out

STATES, EPOCHS, OWN, CLASSES, WINDOW = 12, 6, 1 << 16, 1024, 128
#: Bytes of text in a chunk, chunks in a file, words of chunks in a task that sums counts, windows in one block.
CHUNK, FILE_CHUNKS, PART_ENTRIES, BLOCK = 8 << 20, 16, 500_000, 2048
ADD = 0.1
#: The end of a text as a word; the weight of the corpus's own shares in a state's emissions; units of an expected count.
END, PRIOR, UNIT = H.U(0x656E64), 100.0, 1 << 16
CHUNKS = (
    "chunk long, n_train long, n_words long, ids binary, no_id binary, held binary, lengths binary, tokens binary, words binary, classes binary, counts binary"
)
DEALT = "part int, chunk long, words binary, classes binary, counts binary"
TOTALS = "part int, chunk long, totals binary, own binary, own_counts binary, class_counts binary, class_words binary"
SYMBOLS = "chunk long, ids binary, no_id binary, held binary, lengths binary, symbols binary, known binary, base binary, rare binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits as four rows of bytes, of which the upper are mostly 0."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, texts one after the other with an end behind each, and the texts' lengths."""
    off, raw = H.buffers(batch.column("text"))
    start, end, text, h = H.words(off, raw, lower=True)
    lengths = np.bincount(text, minlength=batch.num_rows) + 1
    where = np.arange(len(h)) + text
    out, classes = np.full(len(h) + batch.num_rows, END), np.zeros(len(h) + batch.num_rows, np.uint16)
    out[where] = h
    if len(h):
        last, before = H._LOWER[raw[end - 1]].astype(np.uint32), np.where(end - start > 1, H._LOWER[raw[end - 2]], 0).astype(np.uint32)
        classes[where] = ((last << np.uint32(8) | before) * np.uint32(40503) & np.uint32(0xFFFF)) % np.uint32(CLASSES)
    return out, classes, lengths


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows under a schema of simple columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def chunk_rows(chunk_bytes: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            ids, no_id, out, tokens, classes, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            words, first, at = np.unique(tokens, return_index=True, return_inverse=True)
            # frequent words first: small numbers
            order = np.argsort(-np.bincount(at), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            train = np.repeat(~out, lengths)
            counts = np.bincount(place[at[train]], minlength=len(words))
            row = (
                task << 32 | made, int(train.sum()), len(words), ids.tobytes(), no_id.tobytes(), out.tobytes(), lengths.astype(np.uint32).tobytes(), planes(place[at]),
                words[order].tobytes(), classes[first[order]].tobytes(), counts.astype(np.uint32).tobytes(),
            )
            return batch_of(CHUNKS, [row])

        for batch in (x for whole in batches for x in H.pieces(whole)):
            ids = batch.column("doc_id")
            held.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(batch.column("held_out")), *tokens_of(batch)))
            size += batch.column("text").nbytes
            if size > chunk_bytes:
                yield done()
                made, size = made + 1, 0
                held.clear()
                H.release()
        if held:
            yield done()

    return run


def dealt(parts: int):  # noqa: ANN201
    """The words of each chunk to parts by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "classes", "counts")), strict=True):
                words, classes, counts = (np.frombuffer(b, t) for b, t in zip(blobs, (np.uint64, np.uint16, np.uint32), strict=True))
                order, cut = by_part(words, parts)
                ends = np.append(cut[1:], len(words))
                yield batch_of(DEALT, [
                    (int(words[order[a]] % H.U(parts)), chunk, words[order[a:b]].tobytes(), classes[order[a:b]].tobytes(), counts[order[a:b]].tobytes())
                    for a, b in zip(cut, ends, strict=True)
                ])

    return run


def by_part(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by part, and where in it each part that has words begins."""
    part = words % H.U(parts)
    order = np.argsort(part, kind="stable")
    return order, np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))


def summed(n_train: int, own_share: int):  # noqa: ANN201
    """Of one part: the sums of its words over all chunks, for each chunk in the order in which it sent them, and in a row
    of its own what the model needs: frequent words, and of the others each class's count and number of words."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(b, t) for b in table.column(c).to_pylist()]
        sent = get("words", np.uint64)
        words, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
        classes = np.concatenate(get("classes", np.uint16))[first]
        total = np.zeros(len(words), np.int64)
        np.add.at(total, at, np.concatenate(get("counts", np.uint32)).astype(np.int64))
        part, back = int(table.column("part")[0].as_py()), total[at]
        ends = np.cumsum([len(x) for x in sent])
        rows = [(part, chunk, back[b - len(x) : b].tobytes(), None, None, None, None) for chunk, x, b in zip(table.column("chunk").to_pylist(), sent, ends, strict=True)]
        own = is_own(total, n_train, own_share)
        rest = (total > 0) & ~own
        per_class = np.bincount(classes[rest], minlength=CLASSES), np.zeros(CLASSES, np.int64)
        np.add.at(per_class[1], classes[rest], total[rest])
        rows.append((part, None, None, words[own].tobytes(), total[own].tobytes(), per_class[1].tobytes(), per_class[0].astype(np.int64).tobytes()))
        H.release()
        return pa.Table.from_batches([batch_of(TOTALS, rows)])

    return run


def is_own(total: np.ndarray, n_train: int, own_share: int) -> np.ndarray:
    return (total > 0) & (total >= -(-n_train // own_share))


def stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """own, key, count, words: frequent words by hash, and classes."""
    for batch in batches:
        for own, own_counts, counts, words in zip(*(batch.column(c).to_pylist() for c in ("own", "own_counts", "class_counts", "class_words")), strict=True):
            key, count = np.frombuffer(own, np.int64), np.frombuffer(own_counts, np.int64)
            each = np.frombuffer(counts, np.int64), np.frombuffer(words, np.int64)
            at = np.flatnonzero(each[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([True, False], [len(key), len(at)])), pa.array(np.append(key, at)), pa.array(np.append(count, each[0][at])), pa.array(np.append(np.ones(len(key), np.int64), each[1][at]))],
                names=["own", "key", "count", "words"],
            )


class Words:
    """What tasks are told of the vocabulary: OWN hashes and CLASSES masses at most."""

    def __init__(self, n: int, own: np.ndarray, own_counts: np.ndarray, class_counts: np.ndarray, class_words: np.ndarray) -> None:
        order = np.argsort(own)
        self.n, self.v = n, len(own) + int(class_words.sum())
        self.own = own[order]
        #: A class's words that are known have their count and ADD, those that are not have ADD together.
        self.mass = class_counts + ADD * class_words + ADD
        share = np.append(own_counts[order] + ADD, self.mass)
        self.share = share / share.sum()

    def symbols(self, words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's symbol, and whether it is its own."""
        if not len(self.own):
            return classes.astype(np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
        own = self.own[at] == words
        return np.where(own, at, len(self.own) + classes.astype(np.int64)), own


def vocabulary(totals: DataFrame, n_train: int) -> Words:
    rows = totals.where("chunk is null").mapInArrow(stat_rows, "own boolean, key long, count long, words long")
    got = rows.groupBy("own", "key").agg(F.sum("count").alias("count"), F.sum("words").alias("words")).toArrow()
    own, key, count, words = (np.asarray(got.column(c)) for c in ("own", "key", "count", "words"))
    classes = np.zeros((2, CLASSES), np.int64)
    classes[:, key[~own]] = count[~own], words[~own]
    return Words(n_train, key[own].view(np.uint64), count[own], *classes)


def with_symbols(told, parts: int):  # noqa: ANN001, ANN201
    """A chunk and its words' sums to symbols, and of each text the known tokens and the sums of logarithms."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vocab, row = told.value, left.to_pylist()[0]
        words, classes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["classes"], np.uint16)
        order, _ = by_part(words, parts)
        back = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist(), strict=True))
        count = np.empty(len(words), np.int64)
        count[order] = np.concatenate([np.frombuffer(b, np.int64) for _, b in back])
        symbol, own = vocab.symbols(words, classes)
        log = np.log10(count + ADD)
        rare = np.where(own, 0.0, log - np.log10(vocab.mass[classes]))
        tokens, lengths = numbers(row["tokens"]), np.frombuffer(row["lengths"], np.uint32)
        first = np.append(0, np.cumsum(lengths.astype(np.int64)))[:-1]
        known, base, rare = (np.add.reduceat(x[tokens], first) for x in ((count > 0).astype(np.int64), log, rare))
        out = (row["chunk"], row["ids"], row["no_id"], row["held"], row["lengths"], planes(symbol[tokens]), known.tobytes(), base.tobytes(), rare.tobytes())
        H.release()
        return pa.Table.from_batches([batch_of(SYMBOLS, [out])])

    return run


class Model:
    """start: by row for windows that begin a text and for others; move: from row to column; emit: a row per symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, share: np.ndarray, states: int) -> Model:
        """The corpus's shares, each state's a little off them, and states that tend to stay."""
        rng = np.random.Generator(np.random.PCG64(5))
        emit = share[:, None] * np.exp(0.5 * rng.standard_normal((len(share), states)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full((2, states), 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """From expected counts; one visit more for each state, and the corpus's shares with the weight PRIOR."""
        emit = emit + PRIOR * share[:, None]
        return cls((start + 1) / (start + 1).sum(1, keepdims=True), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


def windows(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and kind (0: begins a text, 1: goes on) of the windows of texts that lie one after the other."""
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[text] + k * size, np.minimum(size, lengths[text] - k * size), (k > 0).astype(np.int64)


def expected(model: Model, symbols: np.ndarray, first: np.ndarray, length: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over windows, and the logarithm of their likelihood."""
    k = model.move.shape[0]
    start, move, emit, log = np.zeros((2, k)), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    order = np.argsort(-length, kind="stable")
    for block in np.array_split(order, -(-len(order) // BLOCK)) if len(order) else []:
        at, n, which = first[block], length[block], kind[block]
        most = int(n[0])
        live = np.searchsorted(-n, -np.arange(most), "left")  # windows longer than t
        ahead, scale = np.empty((most, len(block), k)), np.empty((most, len(block)))
        for t in range(most):
            m = live[t]
            now = (ahead[t - 1, :m] @ model.move if t else model.start[which]) * model.emit[symbols[at[:m] + t]]
            z = now.sum(1)
            np.divide(now, z[:, None], out=ahead[t, :m])
            scale[t, :m] = z
            log += float(np.log(z).sum())
        back, seen, moved = np.ones((len(block), k)), [], np.zeros((k, k))
        for t in range(most - 1, -1, -1):
            m = live[t]
            s = symbols[at[:m] + t]
            seen.append(s)
            posterior = ahead[t, :m] * back[:m]
            if t:
                v = model.emit[s] * back[:m] / scale[t, :m, None]
                moved += ahead[t - 1, :m].T @ v
                back[:m] = v @ model.move.T
            else:
                np.add.at(start, which, posterior)
            ahead[t, :m] = posterior
        move += moved * model.move
        where, each = np.concatenate(seen), np.concatenate([ahead[t, : live[t]] for t in range(most - 1, -1, -1)])
        for state in range(k):
            emit[:, state] += np.bincount(where, each[:, state], len(emit))
    return start, move, emit, log


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The logarithm of the likelihood of each text as one sequence; all texts at once, the longest last."""
    order = np.argsort(-lengths, kind="stable")
    n, at = lengths[order], (np.cumsum(lengths) - lengths)[order]
    most = int(n.max(initial=0))
    live, log, now = np.searchsorted(-n, -np.arange(most), "left"), np.zeros(len(n)), None
    for t in range(most):
        m = live[t]
        if now is not None and (len(now) > m or t % 8 == 0):  # eight steps can't leave the range of a double
            z = now.sum(1)
            log[: len(z)] += np.log(z)
            now = now[:m] / z[:m, None]
        e = model.emit[symbols[at[:m] + t]]
        now = model.start[np.zeros(m, np.int64)] * e if now is None else (now @ model.move) * e
    if now is not None:
        log[: len(now)] += np.log(now.sum(1))
    out = np.empty(len(n))
    out[order] = log
    return out


def expecting(told):  # noqa: ANN001, ANN201
    """Chunks to expected counts: key and one number per state. Keys are symbols, then states that are left, then the two
    kinds of starts, then the log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = told.value, None
        for batch in batches:
            for held, lengths, symbols in zip(*(batch.column(c).to_pylist() for c in ("held", "lengths", "symbols")), strict=True):
                learn, lengths = ~np.frombuffer(held, bool), np.frombuffer(lengths, np.uint32).astype(np.int64)
                got = expected(model, numbers(symbols)[np.repeat(learn, lengths)], *windows(lengths[learn], WINDOW))
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
                H.release()
        if total is not None:
            start, move, emit, log = total
            last = np.zeros((1, emit.shape[1]))
            last[0, 0] = log
            counts = np.rint(np.concatenate([emit, move, start, last]) * UNIT).astype(np.int64)
            key = np.flatnonzero(counts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(counts[key, s]) for s in range(counts.shape[1]))], names=["key", *(f"s{s}" for s in range(counts.shape[1]))])

    return run


def learned(symbols: DataFrame, vocab: Words, states: int = STATES, epochs: int = EPOCHS) -> tuple[Model, list[float]]:
    """The model after some rounds of Baum-Welch over all training text, and the log-likelihood before each."""
    model, logs, n = Model.first(vocab.share, states), [], len(vocab.share)
    names = [f"s{s}" for s in range(states)]
    for _ in range(epochs):
        told = symbols.sparkSession.sparkContext.broadcast(model)  # OWN + CLASSES rows at most
        rows = symbols.select("held", "lengths", "symbols").mapInArrow(expecting(told), ", ".join(f"{c} long" for c in ["key", *names]))
        got = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # a row per symbol and state
        counts = np.zeros((n + states + 3, states))
        counts[np.asarray(got.column("key"))] = np.stack([np.asarray(got.column(c)) for c in names], 1) / UNIT
        logs.append(float(counts[-1, 0]))
        model = Model.of_counts(counts[n + states : -1], counts[n : n + states], counts[:n], vocab.share)
        told.unpersist()
    return model, logs


def scoring(told):  # noqa: ANN001, ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            for ids, no_id, held, lengths, symbols, known, base, rare in zip(*(batch.column(c).to_pylist() for c in SCORED), strict=True):
                lengths = np.frombuffer(lengths, np.uint32).astype(np.int64)
                log = forward(model, numbers(symbols), lengths) / np.log(10) + np.frombuffer(rare, np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(no_id, bool)), pa.array(np.frombuffer(held, bool)), pa.array(lengths),
                        pa.array(np.frombuffer(known, np.int64)), pa.array(np.frombuffer(base, np.float64)), pa.array(log),
                    ],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )
                H.release()

    return run


SCORED = ["ids", "no_id", "held", "lengths", "symbols", "known", "base", "rare"]


def symbol_chunks(docs: DataFrame, fold: tuple[int, int] = (10, 0), own_share: int = OWN, chunk_bytes: int = CHUNK) -> tuple[DataFrame, Words]:
    """The documents as chunks of symbols, a table, and the vocabulary of the training documents."""
    rows = documents(docs).withColumn("held_out", held_out(F.col("doc_id"), *fold))
    chunks = materialise(rows.mapInArrow(chunk_rows(chunk_bytes), CHUNKS), "chunks", maxRecordsPerFile=FILE_CHUNKS)
    spark = docs.sparkSession
    n_train, entries = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // PART_ENTRIES + 1)
    sent = chunks.select("chunk", "words", "classes", "counts").mapInArrow(dealt(parts), DEALT)
    totals = materialise(sent.groupBy("part").applyInArrow(summed(n_train, own_share), TOTALS), "totals")
    vocab = vocabulary(totals, n_train)
    told = spark.sparkContext.broadcast(vocab)
    back = totals.where("chunk is not null").select("chunk", "part", "totals").groupBy("chunk")
    left = chunks.drop("n_train", "n_words", "counts").groupBy("chunk")
    return materialise(left.cogroup(back).applyInArrow(with_symbols(told, parts), SYMBOLS), "symbols", maxRecordsPerFile=FILE_CHUNKS), vocab


def lm_scores(
    docs: DataFrame, states: int = STATES, epochs: int = EPOCHS, fold: tuple[int, int] = (10, 0), own_share: int = OWN, chunk_bytes: int = CHUNK
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    Tokens are the words with A-Z lower-cased, and an end; a null or empty text is an end alone. Documents whose
    crc32(doc_id) has the fold's remainder are held out; a null doc_id is not. base_score adds up the logarithms of words'
    smoothed shares among training tokens; score is the logarithm (base 10, both) of the text's likelihood under the hidden
    Markov model. Words are told apart by 64 bits. Rows that repeat are learned from as often and have equal scores. Without training
    documents the model knows classes only. An empty table gives no rows; other columns are not read.
    """
    symbols, vocab = symbol_chunks(docs, fold, own_share, chunk_bytes)
    model, _ = learned(symbols, vocab, states, epochs)
    told = docs.sparkSession.sparkContext.broadcast(model)
    scored = symbols.select(*SCORED).mapInArrow(scoring(told), SCORES)
    per_token = float(np.log10(vocab.n + ADD * (vocab.v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score",
    )
