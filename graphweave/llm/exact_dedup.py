"""Exact dedup by a heavy-hitter split (DataFrame functions only).

Misra-Gries sketches, merged in levels, name every digest that more than `support` of all rows have, among about
1/support digests at most. Exact counts over all rows verify them; their winners are broadcast (about 1/support rows at most,
whatever the input's size) and settle their rows on the map side, without a shuffle. All other digests have at most
support * rows rows each and take an ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import ascii_lower, documents, frequent, materialise

SUPPORT = 1 / 10_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text after lower-casing A-Z; null counts as empty."""
    return documents(docs).select("doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """text_sha256, keep_id, group_size of the frequent digests, counted exactly; about 1/support rows at most."""
    heavy = frequent(rows, "text_sha256", support)
    return winners_of(rows.join(F.broadcast(heavy), F.xxhash64("text_sha256") == F.col("item")))


def winners_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id
    stays. A null text counts as empty, so all null and empty texts form one group. A null doc_id never
    wins over another; a group of null ids only keeps them (keep_id null, kept true). Rows that repeat a
    doc_id and its text are the same document, and stay or go together. An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    rows = materialise(digests(docs), "digests")
    winners = materialise(heavy_winners(rows, support), "winners")
    known = rows.join(F.broadcast(winners), "text_sha256", "left")
    light = known.where(F.col("group_size").isNull()).select("doc_id", "text_sha256")
    # counted with a map-side combine; the join streams each digest's rows and holds none of them
    light = light.join(winners_of(light).hint("merge"), "text_sha256")
    return (
        known.where(F.col("group_size").isNotNull())
        .unionByName(light)
        .select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )
    )


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents, with all their columns, without copies: one row of equal texts stays, that with the largest
    doc_id (a null one only where no other row has the text; of equal ones any).

    Rows are told apart by a number of their own in a written table, so that rows which share a doc_id, or
    have none, stay or go by their own text. A null text counts as empty and stays null. An empty table gives no rows.
    """
    # the documents' columns within one, so that no name of theirs is taken
    numbered = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("__row")), "rows")
    slim = numbered.select(F.struct("doc.doc_id", "__row").alias("doc_id"), F.col("doc.text").alias("text"))
    slim = materialise(digests(slim), "digests")
    # the largest (doc_id, row) of each text; a null doc_id is the smallest
    winners = materialise(heavy_winners(slim, support), "winners")
    known = slim.join(F.broadcast(winners), "text_sha256", "left")
    light = winners_of(known.where(F.col("group_size").isNull()).select("doc_id", "text_sha256"))
    stays = winners.unionByName(light).where(F.col("group_size") > 1).select("text_sha256", F.col("keep_id.__row").alias("__stays"))
    gone = slim.join(stays, "text_sha256").where("doc_id.__row <> __stays").select(F.col("doc_id.__row").alias("__row"))
    return numbered.join(gone, "__row", "left_anti").select("doc.*")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW g AS (PARTITION BY t)
"""
