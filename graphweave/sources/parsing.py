"""A chain of parsers: each document goes to the first, and where that fails to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content and name to text. It raises, or returns a blank text, where it can't read the document.
Parser = Callable[[bytes, str], str]

PARSED = "doc_id long, text string, parser string, tier int, attempts array<struct<parser:string,reason:string>>, error string"
_ATTEMPTS = pa.list_(pa.struct([("parser", pa.string()), ("reason", pa.string())]))
# The codes of what can go wrong with a whole document.
NO_PARSERS, ALL_FAILED = "no_parsers_enabled", "all_parsers_failed"
#: Bytes of content that a task holds at once.
MOST = 8 << 20


def raw_text(content: bytes, name: str) -> str:
    """The last tier: UTF-8, else Latin-1."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def tried(parsers: Sequence[tuple[str, Parser]], content: bytes, name: str) -> tuple[str | None, str | None, int | None, list[dict]]:
    """Text, parser and tier of the first parser that reads a document, and why each before it did not."""
    attempts = []
    for tier, (label, parse) in enumerate(parsers):
        try:
            text = parse(content, name)
            if not text or not text.strip():
                raise ValueError("empty_text")
        except Exception as e:  # noqa: BLE001 whatever a parser raises is its reason
            attempts.append({"parser": label, "reason": str(e)})
        else:
            return text, label, tier, attempts
    return None, None, None, attempts


def chained(parsers: Sequence[tuple[str, Parser]]):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            ids, texts, labels, tiers, attempts, errors = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(labels, pa.string()), pa.array(tiers, pa.int32()), pa.array(attempts, _ATTEMPTS), pa.array(errors, pa.string())],
                names=[x.split()[0] for x in PARSED.replace("array<struct<parser:string,reason:string>>", "array").split(", ")],
            )

        for batch in batches:
            rows, size = [], 0
            for doc_id, name, content in zip(*(batch.column(c) for c in ("doc_id", "name", "content")), strict=True):
                raw = content.as_py() or b""
                text, label, tier, attempts = tried(parsers, raw, name.as_py() or "")
                rows.append((doc_id.as_py(), text, label, tier, attempts, None if label else ALL_FAILED if parsers else NO_PARSERS))
                size += len(raw)
                if size > MOST:
                    yield done(rows)
                    rows, size = [], 0
            if rows:
                yield done(rows)

    return run


def parse_chain(files: DataFrame, parsers: Sequence[tuple[str, Parser]]) -> DataFrame:
    """doc_id, text, parser, tier, attempts, error of files (doc_id, name, content): one row per file.

    Parsers (name, function) are tried in order; attempts has the parser and the reason of each that failed before one read the
    file. A file that none reads has the error all_parsers_failed, and without parsers no_parsers_enabled; neither stops the others.
    A null content is empty. A file must fit a task.
    """
    return files.select("doc_id", "name", "content").mapInArrow(chained(tuple(parsers)), PARSED)


def parser_counts(parsed: DataFrame) -> DataFrame:
    """parser, n, fallbacks: what each parser read, and how many of those others had failed on; null for what none read."""
    return parsed.groupBy("parser").agg(F.count("*").alias("n"), F.count_if(F.size("attempts") > 0).alias("fallbacks"))
