"""Elements of documents to chunks: a left-to-right fold per document."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.documents import elements

CHUNK = "doc_id long, chunk_index long, elements long, start_page int, end_page int, chars long, text string, flags array<string>, error string"
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("chunk_index", pa.int64()), ("elements", pa.int64()), ("start_page", pa.int32()), ("end_page", pa.int32()), ("chars", pa.int64()),
    ("text", pa.string()), ("flags", pa.list_(pa.string())), ("error", pa.string()),
])


def fold(types: Sequence[str], texts: Sequence[str], most_chars: int, most_tokens: int) -> list[list[int]]:
    """Element numbers of each chunk. Tables stand alone; an image takes the caption after it; a heading
    begins a chunk; page headers and footers are left out; others join while the limits hold."""
    chunks: list[list[int]] = []
    pending: list[int] = []
    chars = 0
    taken = -1
    for i, (kind, text) in enumerate(zip(types, texts, strict=True)):
        if i == taken or kind in ("header", "footer"):
            continue
        blank, size = not text.strip(), len(text)
        if kind in ("table", "image"):
            if pending:
                chunks.append(pending)
                pending, chars = [], 0
            alone = [i]
            if kind == "image" and i + 1 < len(types) and types[i + 1] == "caption":
                taken = i + 1
                alone.append(taken)
            if any(texts[j].strip() for j in alone):
                chunks.append(alone)
            continue
        grown = chars + 2 + size if pending else size
        if pending and (kind == "heading" or (not blank and (grown > most_chars or grown // 4 > most_tokens))):
            chunks.append(pending)
            pending, grown = [], size
        if not blank:
            pending.append(i)
            chars = grown
    return [*chunks, pending] if pending else chunks


def chunks(parts: DataFrame, most_chars: int = 1000, most_tokens: int = 250) -> DataFrame:
    """One row per chunk of each document's elements (doc_id, pos, element_type, text, page, confidence).

    The elements of one document are in one task, which folds one document after the other. flags: low_ocr_confidence (least confidence under 0.7),
    low_text_density (under 20 stripped characters). error is set where a chunk has no page
    (missing_page_info), or a document no chunk (empty_document, with null chunk_index). Null texts count as
    empty, and blank ones never enter a chunk's text.
    """

    def rows_of(doc_id: int | None, rows: list[tuple]) -> list[tuple]:
        types, texts, pages, sure, raw = zip(*rows, strict=True)
        texts, fallback = [x or "" for x in texts], ["raw_fallback"] if any(raw) else []
        out = []
        for n, at in enumerate(fold(types, texts, most_chars, most_tokens)):
            text = "\n\n".join(texts[i] for i in at if texts[i].strip())
            page = [pages[i] for i in at if pages[i] is not None]
            known = [sure[i] for i in at if sure[i] is not None and not math.isnan(sure[i])]
            flags = (["low_ocr_confidence"] if known and min(known) < 0.7 else []) + (["low_text_density"] if len(text.strip()) < 20 else []) + fallback
            error = None if page else "missing_page_info"
            out.append((doc_id, n, len(at), min(page, default=None), max(page, default=None), len(text), text, flags, error))
        return out or [(doc_id, None, 0, None, None, 0, None, [], "empty_document")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents in rows that follow each other; the last one of a batch may go on in the next."""
        now, held = None, []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        for part in batches:
            out = []
            ids, *columns = (part.column(c).to_pylist() for c in ("doc_id", "element_type", "text", "page", "confidence", "raw"))
            for doc_id, mine in groupby(zip(ids, zip(*columns, strict=True), strict=True), itemgetter(0)):
                if held and doc_id != now:
                    out += rows_of(now, held)
                    held = []
                now = doc_id
                held += [row for _, row in mine]
            if out:
                yield batch(out)
        if held:
            yield batch(rows_of(now, held))

    raw = F.coalesce(F.col("raw").cast("boolean"), F.lit(False)) if "raw" in parts.columns else F.lit(False)
    rows = parts.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "element_type", "text", F.col("page").cast("int").alias("page"), F.col("confidence").cast("double").alias("confidence"), raw.alias("raw"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, CHUNK)


def line_elements(docs: DataFrame) -> DataFrame:
    """The lines of documents as elements without a confidence, for texts that have no blank lines."""
    return elements(docs, "\n").withColumn("confidence", F.lit(None).cast("double"))
