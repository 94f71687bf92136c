"""Conversation prefix trie by vertical bitmaps.

1. A turn becomes a digest and its number of words; a conversation is the path of its digests. Texts go no further.
2. Paths are cut into ranges of their order, so that the members of a node are neighbours, and ranges into shards of
   some thousand conversations. A common first turn, or a conversation with many copies, is in as many shards as it needs.
3. A shard indexes (position, turn) to a bitset of its conversations, which are numbered by their ids. From the root down, a
   node's bitset is intersected with the posting of the next turn of its first open member: that is a child. Bit
   counts are members, lowest bits are smallest ids, and the bits that are also in the bitset of the conversations of
   that length are the node's ends.
4. Only nodes on the path that two neighbouring shards share are in more than one. As a shard knows the path before it and
   the one behind it, each node is counted as a child by the first shard that has it and as a leaf by the last;
   so sums of shards are the nodes' numbers. The other nodes are whole in their shard and are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import materialise
from graphweave.plans.tables import ranged

#: Conversations of a shard, and bytes of their paths.
SHARD, SHARD_BYTES = 4096, 8 << 20
#: Characters of a turn's digest; siblings of one conversation that are rebuilt from it.
DIGEST, FAMILY = 32, 20
ROOT = "root"
NODES = (
    "shard long, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ends string"
)
TYPES = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.string(), pa.string()]
NAMES = [x.split()[0] for x in NODES.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family; none without an id."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % 4, F.lit(0)).cast("int")


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, words: each rebuilt conversation as the joined digests of its turns, and their numbers of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        F.struct(
            "turn", F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"),
        ).alias("t"),
    )
    # one shuffle by family for both: a conversation's turns, and the family's first conversation
    each = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 3))).over(Window.partitionBy("base"))
    each = each.withColumns({"h": head_length(F.col("conv_id")), "first": first})
    empty = F.slice("own", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("first", empty), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    each = each.select("conv_id", rebuilt.alias("turns"))
    return each.select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.words").alias("words"))


def with_neighbours(rows: DataFrame) -> DataFrame:
    """The paths in ranges, and in each the path before it (side -1) and behind it (1)."""
    table = ranged(rows.withColumn("none", F.col("conv_id").isNull()), "path", "none", "conv_id")
    ends = table.groupBy("__range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    order = Window.orderBy("__range")  # one row per range
    ends = ends.select("__range", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("behind"))
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("path")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("path"))))
    lent = ends.select("__range", sides.alias("s")).select("__range", "s.*").where("path is not null")
    return table.withColumn("side", F.lit(0)).unionByName(lent, allowMissingColumns=True)


def bits(x: int) -> Iterator[int]:
    """The places of a bitset's bits, in order."""
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def common(a: str | None, b: str) -> int:
    """How many turns two paths share at their start; -1 without the one."""
    if a is None:
        return -1
    n = min(len(a), len(b)) // DIGEST
    return next((d for d in range(n) if a[d * DIGEST : (d + 1) * DIGEST] != b[d * DIGEST : (d + 1) * DIGEST]), n)


def keys_of(path: str, depth: int) -> list[str]:
    """Names of a path's nodes down to a depth."""
    out = [ROOT]
    for d in range(depth):
        out.append(hashlib.md5((out[-1] + path[d * DIGEST : (d + 1) * DIGEST]).encode()).hexdigest())
    return out


def shard_nodes(number: int, rows: list[tuple], before: str | None, behind: str | None) -> pa.RecordBatch:
    """The nodes of a shard's conversations (conv_id, path, words), which are in the order of their paths."""
    known, goes_on = common(before, rows[0][1]), common(behind, rows[-1][1])
    shared = {-1: keys_of(rows[0][1], known), 1: keys_of(rows[-1][1], goes_on)}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    edge = {-1: 1 << order.index(0), 1: 1 << order.index(len(rows) - 1)}
    ids = [rows[i][0] for i in order]
    turns = [[rows[i][1][k : k + DIGEST] for k in range(0, len(rows[i][1]), DIGEST)] for i in order]
    words = [rows[i][2] for i in order]
    postings: dict[tuple[int, str], int] = {}
    ended: dict[int, int] = {}
    for c, path in enumerate(turns):
        bit = 1 << c
        for d, t in enumerate(path):
            postings[d, t] = postings.get((d, t), 0) | bit
        ended[len(path)] = ended.get(len(path), 0) | bit
    nodes: list[list] = []
    stack = [(0, (1 << len(rows)) - 1, -1)]
    while stack:
        depth, members, parent = stack.pop()
        low = (members & -members).bit_length() - 1
        old, open_ = depth <= known and bool(members & edge[-1]), depth <= goes_on and bool(members & edge[1])
        ends = members & ended.get(depth, 0)
        rest, at, children = members ^ ends, len(nodes), []
        while rest:
            c = (rest & -rest).bit_length() - 1
            child = members & postings[depth, turns[c][depth]]
            children.append((depth + 1, child, at))
            rest ^= child
        n, w = members.bit_count(), words[low][depth - 1] if depth else 0
        key = shared[-1][depth] if old else shared[1][depth] if open_ else None
        ends_text = ",".join(str(ids[c]) for c in bits(ends) if ids[c] is not None)
        above = nodes[parent] if parent >= 0 else None
        if above is not None and not old:
            above[7] += 1
        nodes.append([
            number, key, above[1] if above else None, ids[low], depth, above[3] if above else None, n, 0, int(not children and not open_), n * w - (0 if old else w),
            None if key else hashlib.sha256(ends_text.encode()).hexdigest(), ends_text if key and ends_text else None, parent,
        ])
        stack += children
    for node in reversed(nodes):
        if node[-1] >= 0:
            for k in (8, 9):
                nodes[node[-1]][k] += node[k]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*nodes, strict=True))[:-1], TYPES, strict=True)], names=NAMES)


def node_rows(most: int):  # noqa: ANN201
    """Rows sorted by range, side and path to the nodes of their shards; the next row shows how a shard's paths go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, number, before, rows, size = None, 0, None, [], 0
        for batch in batches:
            for at, side, conv_id, path, words in zip(*(batch.column(c).to_pylist() for c in ("__range", "side", "conv_id", "path", "words")), strict=True):
                if rows and (at != where or side > 0 or len(rows) >= most or size > SHARD_BYTES):
                    yield shard_nodes(where << 32 | number, rows, before, path if at == where else None)
                    before, rows, size, number = rows[-1][1], [], 0, number + 1
                if at != where:
                    where, number, before = at, 0, None
                if side < 0:
                    before = path
                elif side == 0:
                    rows.append((conv_id, path, words))
                    size += len(path)
        if rows:
            yield shard_nodes(where << 32 | number, rows, before, None)

    return run


def end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists of ends, sorted by node and shard, to the hash of each list; only the hash's state is held."""
    key, hashed = None, None
    for batch in batches:
        out = []
        for name, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != key:
                out += [(key, hashed.hexdigest())] if hashed else []
                key, hashed = name, hashlib.sha256(text.encode())
            else:
                hashed.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["key", "ends_sha256"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([hashed.hexdigest()])], names=["key", "ends_sha256"])


def conversation_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    Turns are in the order of turn (null first), those that share one in the order of their digest; a null role or text is
    empty. A conversation's first crc32(conv_id) % 4 turns are replaced by the first as many of the conversation
    whose id is the multiple of 20 before it. A node is a distinct start of a rebuilt conversation, the root included.
    Rows without a conv_id are one conversation, taken as it is; it counts as a member and is in no list of ids.
    Repeated rows are repeated turns. An empty table gives no rows; other columns are not read. A
    conversation (about 40 bytes a turn) must fit a task.
    """
    rows = with_neighbours(paths(conversations))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "__range").sortWithinPartitions("__range", "side", "path", "none", "conv_id")
    nodes = materialise(dealt.select("__range", "side", "conv_id", "path", "words").mapInArrow(node_rows(shard), NODES), "nodes")
    shared, whole = nodes.where("key is not null"), nodes.where("key is null")
    ends = shared.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    hashes = ends.select("key", "ends").mapInArrow(end_hashes, "key string, ends_sha256 string")
    merged = shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = materialise(merged.join(hashes, "key", "left").fillna(hashlib.sha256(b"").hexdigest(), "ends_sha256"), "merged")
    least = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(least, "parent_key", "left").select(*RESULT)
    # nodes below a shared one look its id up within their shard, so that no parent has more children than a shard holds
    told = shared.select("shard", F.col("key").alias("parent_key")).join(least.withColumnRenamed("parent_conv_id", "told"), "parent_key")
    below = whole.where("parent_key is not null").join(told, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("told"))
    return whole.where("parent_key is null").select(*RESULT).unionByName(below.select(*RESULT)).unionByName(top)


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations),
ids AS (
  SELECT DISTINCT c, base, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))),
    4294967295::UBIGINT) % 4 AS h FROM t),
rebuilt AS (
  SELECT ids.c, t.i, t.role, t.text FROM ids JOIN t ON t.c = ids.base AND t.i <= ids.h
  UNION ALL SELECT ids.c, t.i + 1000000, t.role, t.text FROM ids JOIN t ON t.c = ids.c AND t.i > ids.h),
turns AS (
  SELECT c, text, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path FROM rebuilt
  WINDOW w AS (PARTITION BY c ORDER BY i)),
starts AS (
  SELECT c, d, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids),
whole AS (SELECT c, max(d) AS d, max_by(path, d) AS path FROM starts GROUP BY c),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, max(words) AS words FROM starts GROUP BY path, d),
kids AS (SELECT left(path, 32 * (d - 1)) AS above, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS list FROM whole GROUP BY path),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, coalesce(list, '') AS list FROM nodes LEFT JOIN kids ON above = nodes.path LEFT JOIN ends ON ends.path = nodes.path),
below AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.words) AS saved_tokens
  FROM full_ b JOIN full_ a ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  sha256(f.list) AS ends_sha256
FROM full_ f JOIN below USING (path) LEFT JOIN full_ p ON f.d > 0 AND p.path = left(f.path, 32 * (f.d - 1))
"""
