"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it meets the block size's condition, and each
chunk adds one character of 64 to the signature. A fingerprint holds the signatures at a block size and at
twice it, as `size:signature:signature`. Fingerprints compare by edit distance at the block sizes they share;
two signatures without a common run of seven characters are unrelated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import documents, materialise

LENGTH, LEAST = 64, 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes of text in a range of documents that one task walks, and the most ranges: their bounds are one literal.
RANGE_BYTES, RANGES = 16 << 20, 1 << 15
#: Texts that a task knows to have met before it starts anew, and rows that one row stands for at most.
HELD, MOST_COPIES = 200_000, 10_000
NAMES = ["doc_id", "text_hash", "text", "n"]


def rolling(raw: np.ndarray) -> np.ndarray:
    """At each byte a hash of it and the six bytes before it."""
    w = (raw.astype(np.uint64) + H.U(1)) * H.U(0x9E3779B97F4A7C15)
    w ^= w >> H.U(31)
    out = w.copy()
    for back in range(1, 7):
        out[back:] += w[:-back] * H.U(pow(0x2545F4914F6CDD1D, back, 2**64))
    out ^= out >> H.U(33)
    out *= H.U(0xFF51AFD7ED558CCD)
    return out


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text; equal texts have equal ones, and an empty text has `3::`."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    if not len(raw):
        return [f"{LEAST}::"] * len(texts)
    bits = rolling(raw)
    roll = (bits >> H.U(40)).astype(np.uint32)
    for back in range(6):  # the first bytes of a text see no bytes of the one before
        at = off[:-1] + back
        roll[at[(at < off[1:])]] = 0
    # level of a byte: how many doublings of the least block size its hash is a boundary for
    edge = np.flatnonzero(roll % np.uint32(LEAST) == LEAST - 1)
    # 21 bits of what is left of the upper part, then those of the lower part, for texts of any length
    value = (roll[edge] // np.uint32(LEAST)).astype(np.int64) & 0x1FFFFF | (bits[edge] & H.U(0xFFFFFF)).astype(np.int64) << 21
    level = np.zeros(len(edge), np.int8)
    open_ = np.ones(len(edge), bool)
    for k in range(1, 30):
        open_ &= (value >> (k - 1)) & 1 == 1
        level += open_
    up, down = H.powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(H._BYTE[raw] * up[: len(raw)], out=sums[1:])

    def signature(a: int, b: int, at: np.ndarray, most: int) -> bytes:
        """One character per chunk of raw[a:b]; from the last place on, one for all that is left."""
        ends = at[: most - 1] + 1
        starts = np.append(a, ends)
        ends = ends if len(ends) and ends[-1] == b else np.append(ends, b)
        h = H.mix((sums[ends] - sums[starts[: len(ends)]]) * down[starts[: len(ends)]])
        return ALPHABET[(h >> H.U(58)).astype(np.int64)].tobytes()

    first = np.searchsorted(edge, off)
    out = []
    for i in range(len(texts)):
        a, b = int(off[i]), int(off[i + 1])
        if a == b:
            out.append(f"{LEAST}::")
            continue
        at, lv = edge[first[i] : first[i + 1]], level[first[i] : first[i + 1]]
        k = 0
        while (LEAST << k) * LENGTH < b - a and k < 28:
            k += 1
        while k and np.count_nonzero(lv >= k) < LENGTH // 2 - 1:
            k -= 1
        one, two = (signature(a, b, at[lv >= j], m) for j, m in ((k, LENGTH), (k + 1, LENGTH // 2)))
        out.append(f"{LEAST << k}:{one.decode()}:{two.decode()}")
    return out


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of signatures of up to 64 characters, all pairs at once: the bits of one
    64-bit word hold a column of each pair's table."""
    n = len(a)
    pad = lambda x: np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in x), np.uint8).reshape(n, LENGTH)
    pa_, pb = pad(a), pad(b)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    one = H.U(1)
    last = one << np.maximum(la - 1, 0).astype(np.uint64)
    pv, mv, score = np.full(n, ~H.U(0), np.uint64), np.zeros(n, np.uint64), la.copy()
    for j in range(int(lb.max(initial=0))):
        eq = np.packbits(pa_ == pb[:, j : j + 1], axis=1, bitorder="little").view("<u8").ravel()
        live = j < lb
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += live & (ph & last != 0)
        score -= live & (mh & last != 0)
        ph = (ph << one) | one
        mh = mh << one
        pv, mv = (mh | ~(xv | ph)), ph & xv
    return np.where(la == 0, lb, np.where(lb == 0, la, score))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: the best of 1 - distance / longer length over the block
    sizes that both have; equal fingerprints are 1, and so are two empty ones."""
    out = np.zeros(len(pairs))
    todo: list[tuple[int, bytes, bytes]] = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for s, t in ([(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if p == 2 * q else [(p2, q1)] if q == 2 * p else []):
            need = min(7, max(len(s), len(t)))
            if len(s) >= need and len(t) >= need and not {s[k : k + need] for k in range(len(s) - need + 1)}.isdisjoint(t[k : k + need] for k in range(len(t) - need + 1)):
                todo.append((i, s.encode(), t.encode()))
    if todo:
        at, s, t = zip(*todo, strict=True)
        longer = np.array([max(len(x), len(y)) for x, y in zip(s, t, strict=True)])
        np.maximum.at(out, np.array(at), 1 - distances(list(s), list(t)) / longer)
    return out


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in H.pieces(whole, most=2 << 20):
            prints = fingerprints([t.encode() for t in batch.column("text").fill_null("").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: one row per document; a null text counts as empty."""
    return documents(docs).mapInArrow(fingerprint_rows, "doc_id long, fingerprint string")


def once_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once per task and doc_id, with a row of its own at the end that says how often it came again."""
    again: dict[tuple[int, int], int] = {}

    def counts() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in again.items() if n]
        again.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.nulls(len(rows), pa.string()), pa.array(columns[2], pa.int64())], names=NAMES)

    for batch in batches:
        new = []
        for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)):
            if key in again:
                again[key] += 1
            else:
                again[key] = 0
                new.append(i)
        rows = batch.take(pa.array(new, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in NAMES[:3]), pa.array(np.ones(len(new), np.int64))], names=NAMES)
        if len(again) > HELD:
            yield counts()
    yield counts()


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, doc_id from the largest down, hash and text: each text with the one that follows, and where it
    came again, with itself."""
    import hashlib

    def done(rows: list[tuple[int, str, str, int]]) -> pa.RecordBatch:
        texts = [t.encode() for _, t, _, _ in rows]
        new = [edited(t, u).encode() for _, t, u, _ in rows]
        own, changed, following = fingerprints(texts), fingerprints(new), fingerprints([u.encode() for _, _, u, _ in rows])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in new]),
                pa.array(own), pa.array(changed),
                pa.array(likeness(list(zip(own, changed, strict=True)))),
                pa.array(likeness(list(zip(own, following, strict=True)))),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"],
        )

    before, rows, size = None, [], 0
    for batch in batches:
        for where, doc_id, text_hash, text, n, borrowed in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text_hash", "text", "n", "borrowed")), strict=True):
            if before is not None and before[:3] == (where, doc_id, text_hash) and not borrowed:
                rows += [(doc_id, before[3], before[3], min(MOST_COPIES, n - k)) for k in range(0, n, MOST_COPIES)]
                size += 2 * len(before[3])
            else:
                if before is not None and before[0] == where:
                    rows.append((before[1], before[3], text, 1))
                    size += len(before[3]) + len(text)
                before = None if borrowed else (where, doc_id, text_hash, text)
                if not borrowed and n > 1:
                    rows += [(doc_id, text, text, min(MOST_COPIES, n - 1 - k)) for k in range(0, n - 1, MOST_COPIES)]
            if size > 1 << 20:
                yield done(rows)
                rows, size = [], 0
    if rows:
        yield done(rows)


def cuts_of(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """At most ranges - 1 ascending (doc_id, turned hash) that part the bytes about evenly: quantiles of a sample of about 16
    rows a range in which a row's chance is its size. They steer only how the work is dealt."""
    total = rows.agg(F.sum("bytes")).first()[0]
    if not total or ranges < 2:
        return []
    drawn = rows.where(F.rand(5) < F.col("bytes") * F.lit(min(1.0, 16 * ranges / total))).select("doc_id", "turned").toArrow()
    found = sorted(zip(drawn.column("doc_id").to_pylist(), drawn.column("turned").to_pylist(), strict=True))
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def place_of(doc_id: Column, turned: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the ascending cuts are less than (doc_id, turned), by bisection."""
    if not cuts:
        return F.lit(0)
    ids, hashes = (F.array(*map(F.lit, x)) for x in zip(*cuts, strict=True))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    less = lambda at: (F.get(ids, at) < doc_id) | ((F.get(ids, at) == doc_id) & (F.get(hashes, at) < turned))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(less(at + step - 1), at + step).otherwise(at))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """range, doc_id, text_hash, text, n, borrowed: each text in the range of its doc_id and hash (n times; a null text
    stands for one that came before in its task), and at the end of each range a copy of the document that comes next
    (after the last range: the first document), so that every task finds each document's successor beside it.

    The order is that of descending doc_id, then of the text's hash, so that rows which share an id, or have none, are in
    as many ranges as they fill. Only copies of one text under one id stay together, as one row per task.
    """
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("text_hash")]
    rows = documents(docs).select(*key, "text")
    turned = F.bitwise_not("text_hash")
    slim = materialise(rows.select("doc_id", turned.alias("turned"), (F.octet_length("text") + 1).cast("long").alias("bytes")), "sizes")
    ranges = min(RANGES, -(-(slim.agg(F.sum("bytes")).first()[0] or 0) // range_bytes))
    cuts = cuts_of(slim, ranges)
    once = rows.mapInArrow(once_rows, "doc_id long, text_hash long, text string, n long")
    once = once.withColumn("range", place_of(F.col("doc_id"), turned, cuts))
    # the first document of each range belongs behind the range before it in the order of descending doc_id
    heads = slim.groupBy(place_of(F.col("doc_id"), F.col("turned"), cuts).alias("range")).agg(F.max(F.struct("doc_id", "turned")).alias("head"))
    turn = Window.orderBy(F.desc("range"))  # one row per range
    to = F.coalesce(F.lag("range").over(turn), F.min("range").over(Window.partitionBy()))
    heads = heads.select("head.doc_id", F.bitwise_not("head.turned").alias("text_hash"), to.alias("to"))
    # of rows that share id and hash, the text that sorts first
    lent = rows.join(F.broadcast(heads), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "to").agg(F.min("text").alias("text"))
    lent = lent.select("doc_id", "text_hash", "text", F.lit(1).cast("long").alias("n"), F.col("to").alias("range"))
    return once.withColumn("borrowed", F.lit(False)).unionByName(lent.withColumn("borrowed", F.lit(True)))


def query(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. Rows that share a doc_id are in the order of their texts' 64-bit hashes; a null doc_id comes
    last and is returned as null. A single document follows itself. An empty table gives no rows; other columns are
    not read.
    """
    rows = with_next(docs, range_bytes)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "range").sortWithinPartitions("range", "borrowed", F.desc("doc_id"), "text_hash", F.asc_nulls_last("text"))
    out = dealt.select("range", "doc_id", "text_hash", "text", "n", "borrowed").mapInArrow(
        pair_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
