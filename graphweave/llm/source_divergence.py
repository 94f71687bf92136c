"""Source divergence audit over run-length columns.

1. Tasks count terms per language and source in bytes, without an object per text; a language keeps the terms that
   `min_docs` of its documents have. Of each kept term stays its vector: the counts of the sources that have it.
2. The vocabulary of a language is put in the order of those vectors, so that terms with equal counts are
   neighbours; terms with equal vectors are one row with their number. Small sources come first in a vector, as the
   first columns have the fewest runs.
3. Ranges of that order are tasks. Within one, each source's column of counts is cut into runs; for each pair of sources
   the runs' boundaries are intersected, and f is taken once per piece and multiplied by the piece's length.
4. Pieces' sums add up to the pairs' values. They fit 64 bits: all p of a group add up to 10**9 + V at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import materialise

MIN_DOCS, TOP = 30, 50
#: p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)).
SCALE, ADD = 1_000_000_000, 5
#: Entries that a task counts before it hands them on, and bytes of a text that are split at once.
ENTRIES, PIECE = 400_000, 4 << 20
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = "lang string, source string, term binary, count long, docs long"
SUMS = "lang string, a int, b int, value long"


def terms(text: bytes) -> Counter[bytes]:
    """Each term of a UTF-8 text with its count: runs of letters A-Z, lower-cased, and of characters beyond ASCII."""
    clean, out, at = text.translate(_TERM), Counter(), 0
    while at < len(clean):
        to = clean.find(b" ", at + PIECE)
        to = len(clean) if to < 0 else to
        out.update(clean[at:to].split())
        at = to
    return out


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a term is, and in how many documents, per language and source: partial counts of a task."""
    met: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in met.items():
            n = len(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())],
                names=["lang", "source", "term", "count", "docs"],
            )
        met.clear()

    for whole in batches:
        for batch in H.pieces(whole):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                count, docs = met.setdefault((lang, source), (Counter(), Counter()))
                found, before = terms(text.encode()), len(count)
                count.update(found)
                docs.update(found.keys())
                held += len(count) - before
                if held > ENTRIES:
                    yield from flush()
                    held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: in how many rows of the group the term is, and how often."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(count_rows, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return counted.withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, by_source: the terms that min_docs documents of their language have, with the counts
    of the sources that have them."""
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("by_source")
    )
    return by_term.where(F.col("docs") >= min_docs).drop("docs")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, v, lang_n, no: of each occurring group the count N of kept terms and the language's V and N,
    and the group's place in its language: smaller groups first."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_group = kept.select("lang", F.explode("by_source").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.count").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sized = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    return sized.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("n", "source")) - 1)


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term, exactly: the product is a decimal of 31 digits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADD).cast("decimal(20,0)")
    return F.call_function("div", top, (n + v * ADD).cast("decimal(20,0)")) + 1


def runs(at: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and count of each run of a column of `rows` counts, of which those at the places `at` are not 0."""
    column = np.zeros(rows, np.int64)
    column[at] = count
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    return first, column[first]


def pair_sums(position: np.ndarray, row: np.ndarray, count: np.ndarray, length: np.ndarray, n: list[int], v: int) -> np.ndarray:
    """Of each pair of a language's sources the sum of f over some terms. Entries (position, row, count) are what is not 0;
    a row stands for `length` terms with equal counts."""
    order = np.lexsort((row, position))
    cut = np.searchsorted(position[order], np.arange(len(n) + 1))
    before = np.append(0, np.cumsum(length))
    columns = []
    for k, total in enumerate(n):
        own = order[cut[k] : cut[k + 1]]
        first, counts = runs(row[own], count[own], len(length))
        # numbers of Python: the product may need more than 64 bits
        columns.append((first, np.array([1 + SCALE * (c + ADD) // (total + ADD * v) for c in counts.tolist()], np.int64)))
    out = np.zeros((len(n), len(n)), np.int64)
    for a, (first, p) in enumerate(columns):
        for b in range(a + 1, len(n)):
            other, q = columns[b]
            ends = np.union1d(first, other)
            f = np.abs(p[np.searchsorted(first, ends, "right") - 1] - q[np.searchsorted(other, ends, "right") - 1])
            out[a, b] = int((f * np.diff(before[np.append(ends, len(length))])).sum())
    return out


def summed(langs):  # noqa: ANN001, ANN201
    """Rows in the order of their vectors to sums per pair, one set per task and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True) if len(names) else []:
                part, lang = batch.slice(a, b - a), names[a]
                vector, (n, v) = part.column("vector"), langs.value[lang]
                inner = vector.flatten()
                row = np.repeat(np.arange(len(part)), np.diff(vector.offsets.to_numpy()))
                got = pair_sums(inner.field("no").to_numpy(), row, inner.field("count").to_numpy(), part.column("length").to_numpy(), n, v)
                total[lang] = total[lang] + got if lang in total else got
        for lang, sums in total.items():
            a, b = np.triu_indices(len(sums), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])

    return run


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: per pair of places of groups the sum of f over the kept terms. The groups' numbers are told to all
    tasks; they are far fewer than the pairs, which are the result."""
    langs: dict[str, tuple[list[int], int]] = {}
    for r in groups.select("lang", "no", "n", "v").orderBy("lang", "no").collect():
        langs.setdefault(r.lang, ([], r.v))[0].append(r.n)
    told = kept.sparkSession.sparkContext.broadcast(langs)
    entries = kept.select("lang", "term", F.explode("by_source").alias("s")).select("lang", "term", "s.*").join(groups.select("lang", "source", "no"), ["lang", "source"])
    vectors = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "count"))).alias("vector"))
    equal = vectors.groupBy("lang", "vector").agg(F.count("*").alias("length"))
    # ranges are cut by the first counts of a vector, as whole vectors would make the bounds' sample large
    cut = [F.col("lang"), F.slice("vector", 1, 2), F.xxhash64("vector")]
    ordered = equal.repartitionByRange(*cut).sortWithinPartitions("lang", "vector")
    return ordered.mapInArrow(summed(told), SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others and from the language.

    Part `pair`: per other source of the language the sum of |p - q| over the language's kept terms (0 where it keeps
    none). Part `term`: the `top` kept terms that the source has and uses more than the language, by p - q.
    Null text, lang and source count as empty; each row of documents counts, also where it repeats another. Groups without
    terms have pairs and no terms. Ties are in the order of the items' UTF-8. An empty table gives no rows; other
    columns are not read. A language's sources are few enough that their pairs are a result.
    """
    kept = materialise(kept_terms(term_counts(docs), min_docs), "terms")
    groups = materialise(group_sizes(docs, kept), "groups")
    sums = materialise(pair_values(kept, groups), "pairs")
    own = groups.select("lang", "source", "no")
    pairs = own.join(own.select("lang", F.col("source").alias("item"), F.col("no").alias("other")), "lang").where("no <> other")
    ends = {"a": F.least("no", "other"), "b": F.greatest("no", "other")}
    pairs = pairs.withColumns(ends).join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    used = kept.select("lang", "term", "total", F.explode("by_source").alias("s")).select("lang", "term", "total", "s.*").join(groups, ["lang", "source"])
    above = share(F.col("count"), F.col("n"), F.col("v")) - share(F.col("total"), F.col("lang_n"), F.col("v"))
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(used.withColumn("rank", place).where(F.col("rank") <= top))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total) AS ln FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source) USING (lang, source) LEFT JOIN langs USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (n + 5 * v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (total + 5) // (ln + 5 * v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""
