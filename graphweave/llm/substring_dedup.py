"""Substring dedup: suffixes by prefix group, cut at the depth of a window.

A window of `size` words is the path from the root to depth `size` of the suffix tree over all texts; two
occurrences of a repeat share that node. Suffixes are split by a prefix of variable length: the smallest hash
among the window's `size // 2`-word grams (equal windows have equal smallest grams), and neighbouring suffixes
with the same gram travel as one run. Where a count of all windows shows that a gram's bucket would outgrow a
task, as with a phrase that many texts share, the prefix of its windows is extended to the whole window, by a
second hash. In each group suffixes are sorted by path, the deep nodes are the runs of equal paths, and each
occurrence after the first is a repeat. Repeats within one slice of texts are settled at once and send a single
occurrence on, so the most frequent passage costs each group one row per slice.

Windows are equal when 128 bits are: 64 of the prefix and 64 of the path. Of windows that share a gram only the
path tells them apart, but at most BUCKET_WINDOWS of them meet so; those of larger buckets have two
hashes of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import SPACE, documents, materialise

WINDOW = 20
#: Windows in a group, which are about 100 MB of arrays in the task; and in a bucket of grams before their prefix
#: is extended. There are eight buckets to a group.
GROUP_WINDOWS, BUCKET_WINDOWS = 1_500_000, 500_000
#: Buckets that all tasks are told of by name.
MOST_LARGE = 1_000_000
SALT = 0x9E3779B97F4A7C15
RUNS = "group int, doc_id binary, seq binary, runs binary, gram binary, first binary, length binary, path binary, kind int"
PACKED_MARKS = "part int, doc_id binary, seq binary, runs binary, starts binary"
MARKS = "doc_id long, seq long, starts binary"


def windows(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """Text number, start word, smallest gram and path of every window, and the hashes of all words with the number
    of the word that each window begins at."""
    off, raw = H.buffers(batch.column("text"))
    _, _, text, h = H.words(off, raw, lower=False)
    if len(h) < size:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), h, none
    counts = np.bincount(text, minlength=batch.num_rows)
    begin = np.cumsum(counts) - counts
    k = size // 2
    low, width = H.ngrams(h, k), 1
    while width < size - k + 1:  # smallest of all size - k + 1 grams of the window
        step = min(width, size - k + 1 - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    path = H.ngrams(h, size)
    whole = text[: len(path)] == text[size - 1 :]
    at = np.flatnonzero(whole)
    return text[at], at - begin[text[at]], low[at], path[at], h, at


def ranks(ids: np.ndarray, seqs: np.ndarray) -> np.ndarray:
    """The place of each document in the order of ids and seqs; equal ones share a place."""
    order = np.lexsort((seqs, ids))
    out = np.empty(len(ids), np.int64)
    a, b = ids[order], seqs[order]
    out[order] = np.cumsum(np.append(0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(ids) else []
    return out


def repeated(g: np.ndarray, p: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of sorted windows, those that equal one of another place before them."""
    new = np.append(True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return (rank != rank[first]) | (start != start[first])


def later(text: np.ndarray, start: np.ndarray, gram: np.ndarray, path: np.ndarray, ids: np.ndarray, seqs: np.ndarray) -> np.ndarray:
    """Which windows equal one of this batch that starts earlier."""
    key = gram ^ (path * H.U(SALT))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(key), bool)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        rank = ranks(ids, seqs)[text[at]]
        order = np.lexsort((start[at], rank, path[at], gram[at]))
        rank, order = rank[order], at[order]
        out[order] = repeated(gram[order], path[order], rank, start[order])
    return out


def unsettled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Per slice of the batches: ids and seqs of its texts, what windows() gives, and which windows equal one of
    the slice that starts earlier."""
    for whole in batches:
        for batch in H.pieces(whole):
            found = windows(batch, size)
            if len(found[0]):
                ids, seqs = np.asarray(batch.column("doc_id").fill_null(-(2**63))), np.asarray(batch.column("seq"))
                yield ids, seqs, *found, later(*found[:4], ids, seqs)


def bucket_counts(size: int, buckets: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, gram, _, _, _, again in unsettled(batches, size):
            bucket, n = np.unique(gram[~again] % H.U(buckets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n, pa.int64())], names=["bucket", "n"])

    return run


def runs_of(size: int, groups: int, buckets: int, large):  # noqa: ANN001, ANN201
    """Packed runs by group. large: a broadcast of the sorted buckets whose windows are told apart by a second hash; None if all
    are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, seqs, text, start, gram, path, h, at, again in unsettled(batches, size):
            rows: list[tuple] = []
            if again.any():
                t, begins = text[again], start[again]
                cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                n = np.diff(np.append(cut, len(t))).astype(np.uint32)
                rows.append((int(gram[0] % H.U(groups)), ids[t[cut]].tobytes(), seqs[t[cut]].tobytes(), n.tobytes(), b"", begins.astype(np.uint32).tobytes(), b"", b"", 1))
            left = np.flatnonzero(~again)
            text, start, gram, path, at = text[left], start[left], gram[left], path[left], at[left]
            if large.value is None:
                gram = H.ngrams(H.mix(h ^ H.U(SALT)), size)[at]
            elif len(large.value):
                bucket = (gram % H.U(buckets)).astype(np.int64)
                back = np.minimum(np.searchsorted(large.value, bucket), len(large.value) - 1)
                gram = np.where(large.value[back] == bucket, H.ngrams(H.mix(h ^ H.U(SALT)), size)[at], gram)
            # runs: consecutive starts of one text with the same prefix
            new = np.ones(len(left), bool)
            new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (gram[1:] != gram[:-1])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(left)))
            if len(length) and length.max() > 255:  # a gram that repeats itself: more runs
                head = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(head, length, strict=True)])
                length = np.diff(np.append(head, len(left)))
            group = (gram[head] % H.U(groups)).astype(np.int64)
            by = np.lexsort((head, group))  # heads are in the order of texts and starts
            head, length, group = head[by], length[by], group[by]
            expand = np.repeat(head - np.cumsum(length) + length, length) + np.arange(length.sum())
            path, ends = path[expand], np.append(0, np.cumsum(length))
            owner, gram, start = text[head], gram[head], start[head].astype(np.uint32)
            short = length.astype(np.uint8)
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(head) else []
            for a, b in zip(cut, np.append(cut[1:], len(head)), strict=True) if len(head) else []:
                own = owner[a:b]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                rows.append((
                    int(group[a]), ids[own[first]].tobytes(), seqs[own[first]].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(),
                    gram[a:b].tobytes(), start[a:b].tobytes(), short[a:b].tobytes(), path[ends[a] : ends[b]].tobytes(), 0,
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN_TYPES, strict=True)], names=RUN_NAMES)

    return run


RUN_NAMES = ["group", "doc_id", "seq", "runs", "gram", "first", "length", "path", "kind"]
RUN_TYPES = [pa.int32(), *[pa.binary()] * 7, pa.int32()]


def repeats(table: pa.Table, parts: int) -> pa.Table:
    """Of one group: the starts of windows that an earlier one equals, packed by parts of the documents."""
    kind, found = np.asarray(table.column("kind")), []
    column = lambda name, dtype, rows: np.frombuffer(b"".join(table.column(name).take(pa.array(rows)).to_pylist()), dtype)
    done, open_ = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
    if len(done):
        ids, seqs, n = column("doc_id", np.int64, done), column("seq", np.int64, done), column("runs", np.uint32, done)
        found.append((np.repeat(ids, n), np.repeat(seqs, n), column("first", np.uint32, done)))
    if len(open_):
        ids, seqs, runs = column("doc_id", np.int64, open_), column("seq", np.int64, open_), column("runs", np.uint32, open_)
        gram, first = column("gram", np.uint64, open_), column("first", np.uint32, open_)
        length, path = column("length", np.uint8, open_).astype(np.int64), column("path", np.uint64, open_)
        row = np.repeat(np.arange(len(ids)), runs)
        ends = np.cumsum(length)
        # a gram met once has no repeat
        ordered = np.sort(gram)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            back = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
            keep = np.flatnonzero(twice[back] == gram)
            n = length[keep]
            expand = np.repeat(ends[keep] - np.cumsum(n), n) + np.arange(n.sum())
            r, g, p = np.repeat(row[keep], n), np.repeat(back[keep], n), path[expand]
            start = np.repeat(first[keep].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rank = ranks(ids, seqs)[r]
            order = np.lexsort((start, rank, p, g))
            again = order[repeated(g[order], p[order], rank[order], start[order])]
            found.append((ids[r[again]], seqs[r[again]], start[again].astype(np.uint32)))
    rows: list[tuple] = []
    if found:
        ids, seqs, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        part = (H.mix(seqs.astype(np.uint64)) % H.U(parts)).astype(np.int64)
        order = np.lexsort((starts, seqs, ids, part))
        ids, seqs, starts, part = ids[order], seqs[order], starts[order], part[order]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True) if len(part) else []:
            i, q = ids[a:b], seqs[a:b]
            head = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (q[1:] != q[:-1])))
            n = np.diff(np.append(head, b - a)).astype(np.uint32)
            rows.append((int(part[a]), i[head].tobytes(), q[head].tobytes(), n.tobytes(), starts[a:b].tobytes()))
    types = [pa.int32(), *[pa.binary()] * 4]
    H.release()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["part", "doc_id", "seq", "runs", "starts"])


def by_document(table: pa.Table) -> pa.Table:
    """Of one part: each document's starts."""
    get = lambda c, dtype: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype)
    n = get("runs", np.uint32)
    ids, seqs, starts = np.repeat(get("doc_id", np.int64), n), np.repeat(get("seq", np.int64), n), get("starts", np.uint32)
    order = np.lexsort((starts, seqs, ids))
    ids, seqs, starts = ids[order], seqs[order], starts[order]
    head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (seqs[1:] != seqs[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(ids))
    out = (ids[head], seqs[head], [starts[a:b].tobytes() for a, b in zip(head, ends, strict=True)])
    return pa.table([pa.array(c, t) for c, t in zip(out, MARK_TYPES, strict=True)], names=["doc_id", "seq", "starts"])


MARK_TYPES = [pa.int64(), pa.int64(), pa.binary()]


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and seq, which tells rows that share a doc_id (or have none) apart."""
    return documents(docs).withColumn("seq", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, size: int = WINDOW, group_windows: int = GROUP_WINDOWS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, seq, starts: little-endian 32-bit word numbers where a window starts that also starts
    earlier (a smaller doc_id, or the same document and an earlier start)."""
    rows = numbered(docs)
    # a text has a word more than it has white space at most: as many windows there are, and no more, however short words are
    blanks = F.octet_length("text") - F.octet_length(F.translate("text", SPACE, "")) + 1
    most = rows.agg(F.sum(blanks)).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-most // group_windows))
    buckets = 8 * groups
    counts = rows.mapInArrow(bucket_counts(size, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # one for bucket_windows windows at most, in practice a few; where there are many, all are taken for large, with the same result
    large = counts.where(F.col("n") > bucket_windows).select("bucket").limit(MOST_LARGE + 1).toArrow().column("bucket")
    large = rows.sparkSession.sparkContext.broadcast(None if len(large) > MOST_LARGE else np.sort(np.asarray(large)))
    found = rows.mapInArrow(runs_of(size, groups, buckets, large), RUNS).groupBy("group").applyInArrow(lambda t: repeats(t, groups), PACKED_MARKS)
    return materialise(found.groupBy("part").applyInArrow(by_document, MARKS), "repeats")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))


def cut_out(size: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.pieces(whole):
                texts, marks = batch.column("text").to_pylist(), batch.column("starts").to_pylist()
                out: list[tuple] = []
                for text, blob in zip(texts, marks, strict=True):
                    got = text.encode().split()  # at space and \x09-\x0D
                    n, gone, spans = len(got), 0, []
                    if blob:
                        at = np.frombuffer(blob, np.uint32).astype(np.int64)
                        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
                        stays = np.cumsum(edge)[:n] == 0
                        gone = n - int(stays.sum())
                        # maximal runs of words that go
                        turn = np.flatnonzero(np.diff(np.concatenate([[1], stays.astype(np.int8), [1]])))
                        spans = [{"start": int(i), "words": int(j - i)} for i, j in zip(turn[::2], turn[1::2], strict=True)]
                        got = list(compress(got, stays.tolist()))
                    out.append((n, gone, b" ".join(got).decode(), spans))
                n, gone, kept, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, SPANS)],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
                )

    return run


def substring_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans: each document without the words of repeated windows, and the
    maximal passages (start word, words) that went.

    Words are runs without space and \\x09-\\x0D; a null or empty text has none. Windows are judged on the
    input. A null doc_id counts as the smallest, and rows that share a doc_id are ordered by a hash of
    their text; rows equal in both are one document, so neither repeats the other. An empty table gives
    no rows; other columns are not read.
    """
    rows = numbered(docs)
    marks = repeated_windows(docs, size).withColumnsRenamed({"doc_id": "__id", "seq": "__seq"})
    id_ = F.coalesce(rows["doc_id"], F.lit(-(2**63)))
    both = rows.join(marks, (id_ == marks["__id"]) & (rows["seq"] == marks["__seq"]), "left")
    return both.select("doc_id", "text", "starts").mapInArrow(
        cut_out(size), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,words:int>>"
    )


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; nulls, repeats and empty tables as in substring_dedup."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM split WHERE len(ws) >= 20),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS w FROM starts),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(w, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS text
  FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
