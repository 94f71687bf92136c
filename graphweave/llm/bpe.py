"""BPE encoding and decoding with tree concatenation.

A text is halved until its parts are short, the parts are encoded on their own (parts of very long texts in
parallel, as rows of their own), and the encodings are joined up the tree. Where a half ends at white space
after ink, no token can span the join and the halves are simply concatenated. Where long unsplit text leaves
no such place, a window of tokens around the join is encoded again and grows until its first token
equals the left side's and its last the right side's: a sequence of BPE tokens is the encoding of its text
exactly when each neighbouring pair is, and then each pair lies in one of three valid encodings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import documents

#: The byte-level split pattern of this vocabulary's family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points in a leaf of unsplit text; texts over LONG are cut into rows of PART.
LEAF, PART, LONG = 1000, 50_000, 100_000
_SPLIT = regex.compile(PATTERN)
_BREAK = regex.compile(r"(?<=\S)(?=\s)")
#: The same from the end backwards: the last such place.
_LAST = regex.compile(r"(?r)(?<=\S)(?=\s)")
_loaded: dict[str, Bpe] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: itself, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A tokenizers file of a byte-level BPE without normaliser: encode and decode whole texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {b: i for i, b in self.bytes.items()}
        self.bytes |= {i: t.encode() for t, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """The encoding of the two texts as one piece, from their own encodings."""
        while left and right:
            a, b = left[-window:], right[:window]
            mid = self.bytes_encode(b"".join(map(self.table.__getitem__, a + b)))
            at_left = window >= len(left) or mid[0] == a[0]
            at_right = window >= len(right) or mid[-1] == b[-1]
            if at_left and at_right:
                return left[:-window] + mid + right[window:]
            window *= 2
        return left or right

    def bytes_encode(self, raw: bytes) -> list[int]:
        return self.coder._core_bpe.encode_single_piece(raw)

    def piece(self, raw: bytes) -> list[int]:
        """One piece of the split pattern, however long."""
        if len(raw) <= LEAF:
            return self.bytes_encode(raw)
        half = len(raw) // 2
        return self.join(self.piece(raw[:half]), self.piece(raw[half:]))

    def plain(self, text: str) -> list[int]:
        """Text without special tokens, by halves down to leaves."""
        if len(text) <= LEAF * 8:
            # short texts go to the coder whole, unless a piece is long
            runs = [len(w) for w in text.split()]
            if max(runs, default=0) < LEAF and len(text) - sum(runs) - len(runs) < LEAF:
                return self.coder.encode_ordinary(text)
            out: list[int] = []
            for m in _SPLIT.finditer(text):
                out += self.piece(m.group().encode())
            return out
        half = len(text) // 2
        last, following = _LAST.search(text, 1, half + 1), _BREAK.search(text, half)
        left, right = last.start() if last else 0, following.start() if following else len(text)
        if right - left < LEAF:
            return self.plain(text[:right]) + self.plain(text[right:])
        # the middle has no break: what is on its sides is at most half each, so the tree stays flat
        out = self.plain(text[:left])
        for m in _SPLIT.finditer(text[left:right]):
            out += self.piece(m.group().encode())
        return out + self.plain(text[right:])

    def unbroken(self, text: str) -> Iterator[tuple[int, str]]:
        """Text without breaks as rows of about PART code points: 0 and text that ends where a piece of the
        split pattern does, or 1 and the start of a piece longer than that, then 2 and each of its further parts."""
        row: list[str] = []
        size = 0
        for part in self.cut.split(text) if self.cut else [text]:
            for unit in [part] if part in self.special else (m.group() for m in _SPLIT.finditer(part)):
                if row and size + len(unit) > PART:
                    yield 0, "".join(row)
                    row, size = [], 0
                if len(unit) > PART:
                    for at in range(0, len(unit), PART):
                        yield 2 if at else 1, unit[at : at + PART]
                else:
                    row.append(unit)
                    size += len(unit)
        if row:
            yield 0, "".join(row)

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """The tokenizer, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def coded(batch: pa.RecordBatch, columns: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The batch without some columns and with others."""
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in drop} | columns
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def encode_rows(path: str, decode: bool = False):  # noqa: ANN201
    """ids in the place of text; with decode the text that the ids give stands beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in (x for batch in batches for x in H.pieces(batch)):
            texts = part.column("text").to_pylist()
            inside = part.column("inside").to_pylist() if "inside" in part.schema.names else [0] * len(texts)
            ids = [bpe.piece(t.encode()) if i else bpe.encode(t) for t, i in zip(texts, inside, strict=True)]
            out = {"ids": pa.array([np.array(x, np.uint32).tobytes() for x in ids], pa.binary())}
            if decode:
                out["text"] = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield coded(part, out, ("text",))

    return run


def cut_rows(path: str):  # noqa: ANN201
    """Long texts as parts of about PART code points, each cut before white space that follows ink; where
    the next such place is further than PART on, by Bpe.unbroken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                at, rows = 0, []
                while at < len(text) or not rows:
                    m = _BREAK.search(text, at + PART) if at + PART < len(text) else None
                    to = m.start() if m else len(text)
                    for inside, part in [(0, text[at:to])] if to - at <= 2 * PART else bpe.unbroken(text[at:to]):
                        rows.append((key, doc_id, len(rows), inside, part))
                    at = to
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                    names=["key", "doc_id", "part", "inside", "text"],
                )

    return run


def joined(path: str, decode: bool = False):  # noqa: ANN201
    """One long document's parts in order; those inside one piece are joined in pairs, up a tree."""

    def run(table: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(np.asarray(table.column("part"))))
        blobs, inside = (table.column(c).take(order).to_pylist() for c in ("ids", "inside"))
        at, out = 0, []
        while at < len(blobs):
            to = at + 1
            while inside[at] and to < len(blobs) and inside[to] == 2:
                to += 1
            level = blobs[at:to]
            if len(level) > 1:
                bpe, parts = load(path), [np.frombuffer(b, np.uint32).tolist() for b in level]
                while len(parts) > 1:
                    parts = [bpe.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                level = [np.array(parts[0], np.uint32).tobytes()]
            out += level
            at = to
        got = {"doc_id": table.column("doc_id")[:1], "ids": pa.array([b"".join(out)], pa.binary())}
        if decode:
            got["text"] = pa.array([load(path).decode(np.frombuffer(b"".join(out), np.uint32).tolist())])
        return pa.table(got)

    return run


def bpe_encode(docs: DataFrame, path: str | None = None, long: int = LONG, decode: bool = False) -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit token ids of each whole text, one row per document; with decode
    also text, what the ids give back, in the same pass of a worker.

    A null text counts as empty and has no tokens. Special tokens in a text are encoded as such and none
    is added. Rows that repeat are encoded each; a null doc_id stays null; an empty table gives no
    rows; other columns are not read.
    """
    path = path or default_path()
    rows = documents(docs)
    size = F.char_length("text")
    schema = "doc_id long, ids binary" + ", text string" * decode
    # a special token holds no white space and unbroken() keeps it whole, so no cut goes through one
    short = rows.where(size <= long).mapInArrow(encode_rows(path, decode), schema)
    parts = (
        rows.withColumn("key", F.monotonically_increasing_id())
        .where(size > long)
        .select("key", "doc_id", "text")
        .mapInArrow(cut_rows(path), "key long, doc_id long, part int, inside int, text string")
        .repartition(F.col("key"), F.col("part"))
        .mapInArrow(encode_rows(path), "key long, doc_id long, part int, inside int, ids binary")
    )
    return short.unionByName(parts.groupBy("key").applyInArrow(joined(path, decode), schema))


def decode_rows(path: str):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in (x for batch in batches for x in H.pieces(batch, "ids")):
            text = [bpe.decode(np.frombuffer(b or b"", np.uint32).tolist()) for b in part.column("ids").to_pylist()]
            yield coded(part, {"text": pa.array(text, pa.string())})

    return run


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text: the text of each row's ids, special tokens included; null ids give ''."""
    return encoded.select("doc_id", "ids").mapInArrow(decode_rows(path or default_path()), "doc_id long, ids binary, text string")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; nulls, repeats and empty tables as in bpe_encode."""
    return bpe_encode(docs, path, decode=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
