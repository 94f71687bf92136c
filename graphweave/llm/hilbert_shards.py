"""Sharding along a Hilbert curve (DataFrame functions only).

Several metadata dimensions are quantised to `bits` bits each at the quantiles of all values, the
cell's place on the Hilbert curve is computed with column arithmetic, and runs of the curve's order are cut into
shards, so that each file covers a compact box of all dimensions and its statistics prune on any of them.
Ranks come from a histogram of (curve index, bucket) with running sums in two levels, never from one global sort:
a cell is split into as many hash buckets as its row count needs, so a hot source is ranked by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import documents, materialise

BITS = 4
#: Rows of a bucket, which one task ranks (a cell with more is split), and buckets whose running sum one task takes.
BUCKET_ROWS, RUN_BUCKETS = 500, 2000


def hilbert(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of the cell whose coordinates are axes (0 to 2**bits - 1).

    Array functions walk the levels: undo the rotations from the top level down, Gray-code the axes, then
    interleave their bits, most significant first.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << v).alias("q"), F.lit(i).alias("i")) for v in range(bits - 1, 0, -1) for i in range(n)])
    at = lambda x, i: F.get(x, i)

    def turn(x: Column, s: Column) -> Column:
        on = at(x, s["i"]).bitwiseAND(s["q"]) != 0
        t = F.when(on, s["q"] - 1).otherwise(at(x, F.lit(0)).bitwiseXOR(at(x, s["i"])).bitwiseAND(s["q"] - 1))
        return F.transform(x, lambda v, j: F.when((j == 0) | ((j == s["i"]) & ~on), v.bitwiseXOR(t)).otherwise(v))

    xor = lambda a, v: a.bitwiseXOR(v)
    x = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), turn) if bits > 1 else F.array(*axes)
    x = F.aggregate(F.array(x), F.expr("cast(array() as array<int>)"), lambda _, y: F.transform(
        y, lambda v, j: F.aggregate(F.slice(y, 1, j + 1), F.lit(0), xor)))

    def finish(_: Column, y: Column) -> Column:
        last = at(y, F.lit(n - 1))
        flip = F.aggregate(
            F.array(*[F.lit(1 << v) for v in range(bits - 1, 0, -1)] or [F.lit(0)]),
            F.lit(0),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        return F.transform(y, lambda v: v.bitwiseXOR(flip))

    x = F.aggregate(F.array(x), F.expr("cast(array() as array<int>)"), finish)
    return F.aggregate(
        F.array(x),
        F.lit(0).cast("long"),
        lambda _, y: F.aggregate(
            F.array(*[F.struct(F.lit(v).alias("v"), F.lit(i).alias("i")) for v in range(bits - 1, -1, -1) for i in range(n)]),
            F.lit(0).cast("long"),
            lambda h, s: h * 2 + F.call_function("shiftright", at(y, s["i"]), s["v"]).bitwiseAND(F.lit(1)),
        ),
    )


def bounds(df: DataFrame, dims: list[str], bits: int) -> list[list]:
    """For each dimension at most 2**bits - 1 ascending bounds: the quantiles of all values that are not null."""
    return [quantiles(df.where(F.col(d).isNotNull()).groupBy(d).agg(F.count("*").alias("__n")), d, bits) for d in dims]


def quantiles(counts: DataFrame, d: str, bits: int) -> list:
    """Of counted values (d, __n) those at each 2**bits-th of all rows, in order. Running sums are taken in ranges of the values and over
    the ranges, so no task sees all values; the driver gets the quantiles alone."""
    table = materialise(counts.repartitionByRange(d).withColumn("__range", F.spark_partition_id()), "counts")
    runs = table.groupBy("__range").agg(F.sum("__n").alias("__sum"))
    runs = runs.select("__range", "__sum", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))  # a row per range
    total = runs.agg(F.sum("__sum")).first()[0] or 0
    wanted = F.array(*[F.lit(total * i >> bits).cast("long") for i in range(1, 1 << bits)])
    until = F.sum("__n").over(Window.partitionBy("__range").orderBy(d)) + F.col("__before")
    placed = table.join(F.broadcast(runs), "__range").withColumn("__until", until)
    held = F.exists(wanted, lambda p: (p >= F.col("__until") - F.col("__n")) & (p < F.col("__until")))
    return sorted(r[0] for r in placed.where(held).select(d).collect())


def curve(df: DataFrame, dims: list[str], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """df with the quantised dims, and the names of those columns; null shares the cell of the least values."""
    axes = [f"__x{i}" for i in range(len(dims))]
    over = lambda d, cut: reduce(Column.__add__, [(F.col(d) >= F.lit(v)).cast("int") for v in cut], F.lit(0))
    cuts = [F.coalesce(over(d, cut), F.lit(0)) for d, cut in zip(dims, bounds(df, dims, bits), strict=True)]
    return df.withColumns(dict(zip(axes, cuts, strict=True))), axes


def placed_cells(rows: DataFrame, axes: list[str], bits: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of each cell that has rows its place on the curve and into how many buckets it is split; a table of at most
    2 ** (bits * dimensions) rows, whatever the input's size."""
    cells = rows.groupBy(*axes).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / bucket_rows)).alias("__buckets"))
    return materialise(cells.withColumn("hilbert", hilbert([F.col(a) for a in axes], bits)), "cells")


def ranked(rows: DataFrame, axes: list[str], bits: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with hilbert and rank: gapless from 0 in the order of curve index, bucket, doc_id."""
    cells = placed_cells(rows, axes, bits, bucket_rows)
    placed = materialise(
        rows.join(F.broadcast(cells), axes)
        .withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("__buckets")))
        .select("doc_id", "size", "text_crc32", "hilbert", "__bucket"),
        "placed",
    )
    sums = placed.groupBy("hilbert", "__bucket").agg(F.count("*").alias("__n"))
    # running sums in two levels: over a cell's buckets in runs of RUN_BUCKETS, then over the runs
    sums = sums.withColumn("__run", F.floor(F.col("__bucket") / RUN_BUCKETS))
    runs = sums.groupBy("hilbert", "__run").agg(F.sum("__n").alias("__n"))
    before = Window.orderBy("hilbert", "__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("hilbert", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("hilbert", "__run").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(runs, ["hilbert", "__run"])
        .select("hilbert", "__bucket", (F.col("__inside") + F.col("__before")).alias("__offset"))
    )
    order = Window.partitionBy("hilbert", "__bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("__nth", F.row_number().over(order))
        .join(offsets, ["hilbert", "__bucket"])
        .withColumn("rank", F.col("__offset") + F.col("__nth") - 1)
        .drop("__bucket", "__nth", "__offset")
    )


def hilbert_shards(
    docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "size"), shards: int = 8, bits: int = BITS
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert: one row per document.

    The law is `rows`: the curve's order is cut into runs whose row counts differ by one at most; slot is
    the place in the run, gapless from 0, and grown_shard is null. size is the text's UTF-8 bytes (null:
    none) plus 1. Null dimensions share the cell of the least values. Equal texts may be in several shards, as this
    law allows. Rows with the same cell and bucket are ordered by doc_id,
    checksum and size; full ties are equal rows, whose slots are interchangeable. An empty table gives no
    rows; other columns are not read.
    """
    slim = documents(docs, *[d for d in dims if d != "size"]).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        *[d for d in dims if d != "size"],
    )
    slim = materialise(slim, "shardrows")
    total = slim.count()
    rows = ranked(*curve(slim, list(dims), bits), bits)
    # the first total % shards shards have one row more
    small, more = divmod(total, shards)
    cut, rank = more * (small + 1), F.col("rank")
    shard = F.when(rank < cut, F.floor(rank / (small + 1))).otherwise(
        more + F.floor((rank - cut) / max(small, 1))
    )
    start = F.when(rank < cut, F.col("shard") * (small + 1)).otherwise(cut + (F.col("shard") - more) * small)
    return rows.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (rank - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("lang", "source", "size"), files: int = 8, bits: int = BITS) -> None:
    """Write the documents, with all their columns and `size`, as `files` Parquet files, each a run of the curve's order: so a
    file holds a compact box of all dimensions, and a filter on any of them leaves most files unread.

    Ranges are cut by curve index and then by a hash of the row, so that a cell with many rows, such as those of one source, is in as
    many files as it fills. size is the text's UTF-8 bytes (null: none) plus 1, in place of a column of that name.
    """
    sized = docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    spread, axes = curve(sized, list(dims), bits)
    cells = placed_cells(spread, axes, bits)
    rows = spread.join(F.broadcast(cells), axes).withColumn("__hash", F.xxhash64("doc_id", "text_crc32", "size"))
    out = rows.repartitionByRange(files, "hilbert", "__hash").sortWithinPartitions("hilbert", *dims)
    names = [c for c in docs.columns if c != "size"]
    out.select(*names, "size").write.mode("overwrite").parquet(path)
