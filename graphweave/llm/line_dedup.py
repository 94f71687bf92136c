"""Line dedup (DataFrame functions only): range-partitioned line hashes, sorted by document and position.

Each line of at least `min_chars` becomes (hash, doc_id, position). Hashes that more than `support` of all
lines have (about 1/support at most, found by Misra-Gries sketches merged in levels) are counted with a map-side combine and settled
by a broadcast of their winners. All others that enough documents have are partitioned by ranges of the hash and
sorted within by document (largest first) and position, so that one streaming pass meets the first occurrence
of each line before its repeats. What returns is not text but a compressed bitmap per document of the lines to drop:
64-line words, those without a dropped line left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import SPACE, ascii_lower, documents, frequent, materialise

MIN_CHARS = 20
MIN_DOCS = 3
SUPPORT = 1 / 10_000
BITMAP = "array<struct<word:int,bits:bigint>>"


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id and lines, split at \\n; a null or empty text has one empty line."""
    return documents(docs).select("doc_id", F.split("text", "\n", -1).alias("lines"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hash, doc_id, pos of the lines whose key has min_chars code points; two 64-bit hashes of different
    seed make up the 128-bit hash."""
    lines = split_lines(docs).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("doc_id", "pos", ascii_lower(F.btrim(F.col("line"), F.lit(SPACE))).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        F.format_string("%016x%016x", F.xxhash64("key"), F.xxhash64(F.lit(1), F.col("key"))).alias("hash"),
        "doc_id",
        "pos",
    )


def dropped_lines(rows: DataFrame, min_docs: int = MIN_DOCS, support: float = SUPPORT) -> DataFrame:
    """doc_id, pos of the lines to drop."""
    heavy = frequent(rows, "hash", support)
    per_doc = rows.join(F.broadcast(heavy), F.xxhash64("hash") == F.col("item")).groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    winners = materialise(
        per_doc.groupBy("hash").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "lines"
    )
    known = rows.join(F.broadcast(winners), "hash", "left")
    settled = known.where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))
    light = known.where(F.col("docs").isNull()).select("hash", "doc_id", "pos")
    # how many documents have a line is counted with a map-side combine; lines of fewer go no further
    docs = light.groupBy("hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("docs"))
    several = light.join(docs.where(F.col("docs") >= min_docs).select("hash"), "hash", "left_semi")
    # one pass in the order of document and position: what differs from the line before is an occurrence in a
    # document of its own, and those of the first document stay
    order = Window.partitionBy("hash").orderBy(F.desc_nulls_last("doc_id"), "pos")
    ranged = several.repartitionByRange("hash").withColumn("first", F.first(F.struct("doc_id")).over(order))
    repeats = ranged.where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    return settled.select("doc_id", "pos").unionByName(repeats.select("doc_id", "pos"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, n_dropped, drop_bitmap: bit pos % 64 of word pos div 64 says that line pos goes."""
    words = dropped.groupBy("doc_id", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drop_bitmap"),
    )


def dropped_positions(bitmap: Column) -> Column:
    """The positions in a bitmap, in order; an absent bitmap has none."""
    word = lambda w: F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda b: F.when(F.getbit(w["bits"], b) == 1, w["word"] * 64 + b),
        ),
        lambda x: x.isNotNull(),
    )
    return F.coalesce(F.flatten(F.transform(bitmap, word)), F.expr("cast(array() as array<int>)"))


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, support: float = SUPPORT
) -> DataFrame:
    """doc_id, n_lines, n_dropped, drop_bitmap: one row per document.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least min_chars
    code points found in at least min_docs documents lose all their lines except in the largest doc_id
    that holds it, where all stay. A null or empty text is one empty line. A null doc_id counts as one
    document, smaller than all others; rows that repeat a doc_id are one document to the counts, and
    each gets that document's bitmap. An empty table gives no rows.
    """
    rows = materialise(line_hashes(docs, min_chars), "linehash")
    found = bitmaps(dropped_lines(rows, min_docs, support)).withColumnRenamed("doc_id", "__id")
    counted = split_lines(docs).select("doc_id", F.size("lines").cast("long").alias("n_lines"))
    return counted.join(found, counted["doc_id"].eqNullSafe(found["__id"]), "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.col("drop_bitmap").cast(BITMAP).alias("drop_bitmap"),
    )


def apply_bitmaps(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, drop_bitmap: the lines that stay, joined by \\n."""
    lines = split_lines(docs)
    marks = found.select(
        F.col("doc_id").alias("__id"), "n_dropped", dropped_positions(F.col("drop_bitmap")).alias("gone"), "drop_bitmap"
    )
    both = lines.join(marks, lines["doc_id"].eqNullSafe(marks["__id"]), "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")),
            lambda i: F.element_at(F.col("lines"), i + 1),
        )
    )
    return both.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
        "drop_bitmap",
    )


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, drop_bitmap as a hex string; nulls, repeats and empty tables as in
    line_dedup."""
    found = bitmaps(dropped_lines(materialise(line_hashes(docs), "linehash")))
    hexed = F.array_join(
        F.transform("drop_bitmap", lambda w: F.format_string("%d:%016x", w["word"], w["bits"])), ","
    )
    return apply_bitmaps(docs, found).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.coalesce(hexed, F.lit("")).alias("drop_bitmap"),
    )


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, f.key IS NOT NULL AND doc_id <> f.last AS gone FROM keyed LEFT JOIN frequent f USING (key)),
words AS (
  SELECT doc_id, pos // 64 AS word, bit_or(1::UBIGINT << (pos % 64)::UBIGINT) AS bits
  FROM marked WHERE gone GROUP BY doc_id, pos // 64),
maps AS (
  SELECT doc_id, string_agg(word || ':' || lower(printf('%016x', bits)), ',' ORDER BY word) AS drop_bitmap
  FROM words GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, kept_sha256, coalesce(drop_bitmap, '') AS drop_bitmap
FROM (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
      FROM marked GROUP BY doc_id) LEFT JOIN maps USING (doc_id)
"""
