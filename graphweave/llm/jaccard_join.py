"""N-gram Jaccard join with prefix trees.

1. Each text becomes its set of distinct n-gram hashes. Texts with equal sets are one node: 64 bits name it and
   64 more, of other hashes, tell sets of one name apart.
2. With sets in one global order, linked sets share at least L(n) grams among their first
   n - ceil(t n) + L(n). Nodes whose own prefix shares fewer grams than any partner would need are out;
   prefix grams travel as packed arrays, and grams that repeat within a slice of a batch are settled there, so
   that the most frequent gram costs one entry per slice.
3. What is left falls into groups connected by shared prefix grams. Where linked nodes share k at least, each
   node first leaves out up to k - 1 of the grams that are most frequent of all, such as those of passages that
   many texts share. As all nodes have one order of those, the common gram that comes last in it has k - 1 before it
   in either node, and so is left to both. A group too large for a task is cut by set size (linked sets are
   in one size class or in neighbouring ones), and a size class still too large into bands, of which each
   pair is a task.
4. A task's sets stand in a trie in the task's own order, rarest gram first. It is walked depth first; sets below
   one node share its overlaps, and subtrees whose size or remaining length can't reach the overlap are cut.
5. Links found (each set and the least of its class, not all pairs) give the classes; copies join by their node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import wordhash as H
from graphweave.llm.common import discard, documents, materialise, written

N = 5
#: The threshold as a fraction: a link has DEN * intersection >= NUM * union.
NUM, DEN = 4, 5
#: Prefix entries in a packed group, set entries in one task's trie, and bytes of arrays in one slice.
GROUP_ENTRIES, TASK_ENTRIES, SLICE = 500_000, 1_000_000, 4 << 20
#: Pairs of trie nodes that are compared at once.
BLOCK = 500_000
#: How often a gram is met to be frequent, and how many of the most frequent are told to all tasks (12 bytes each).
FREQUENT, MOST_FREQUENT = 8, 500_000
SETS = "doc_id long, text_hash long, n_shingles long, node long, check long, prefix binary"
#: What names one text of a set: the id (null: the least there is) and the text's hash.
ROW = ["row_id", "row_hash"]
PACKED = "part int, nodes binary, counts binary, grams binary, often binary, done int"


def sets_of(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; with fewer words the whole sequence is one."""
    off, raw = H.buffers(batch.column("text"))
    _, _, text, h = H.words(off, raw, lower=True)
    count = np.bincount(text, minlength=batch.num_rows)
    begin = np.append(0, np.cumsum(count))
    grams = H.ngrams(h, n)
    out = []
    for i in range(batch.num_rows):
        a, b = begin[i], begin[i + 1]
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(H.mix(H.ngrams(h[a:b], int(b - a)) + H.U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least(n: int) -> int:
    """The overlap that a set of n needs at least with any partner: ceil(t n)."""
    return -(-NUM * n // DEN)


def level(n: int) -> int:
    """How many shared prefix grams a set of n looks for; never fewer for a larger set."""
    return max(1, min(n // 4, 62), n // 10)


def needed(n: int) -> int:
    """How many shared prefix grams a set of n has, at least, with any partner."""
    return level(least(n))


def prefix_length(n: int) -> int:
    return min(n, n - least(n) + level(n))


def names_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of the set."""
    out = []
    for salt in (0, 0x9E3779B97F4A7C15):
        x = H.mix(s ^ H.U(salt))
        total = H.mix(np.array([np.bitwise_xor.reduce(x), x.sum(dtype=np.uint64)], np.uint64) + H.U(len(s)))
        out.append(int(H.mix(total[:1] * H.U(3) + total[1:])[0].astype(np.int64)))
    return out[0], out[1]


def set_rows(n: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.pieces(whole):
                sets = sets_of(batch, n)
                names = [names_of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k for k, _ in names], pa.int64()),
                        pa.array([c for _, c in names], pa.int64()),
                        pa.array([s[: prefix_length(len(s))].tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "check", "prefix"],
                )

    return run


def pack(node: np.ndarray, gram: np.ndarray, part: np.ndarray, done: int, often: np.ndarray | None = None) -> Iterator[tuple]:
    """One row per part: its nodes, how many grams each has, those grams, and how often each was met."""
    order = np.lexsort((gram, node, part))
    node, gram, part = node[order], gram[order], part[order]
    often = None if often is None else often[order].astype(np.uint32)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True) if len(part) else []:
        head = np.flatnonzero(np.append(True, node[a + 1 : b] != node[a : b - 1]))
        counts = np.diff(np.append(head, b - a)).astype(np.uint32)
        yield int(part[a]), node[a:b][head].tobytes(), counts.tobytes(), gram[a:b].tobytes(), b"" if often is None else often[a:b].tobytes(), done


def unpack(table: pa.Table, done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, gram and how often it was met, of a packed table's rows of that kind."""
    rows = pa.array(np.flatnonzero(np.asarray(table.column("done")) == done))
    get = lambda c, dtype: np.frombuffer(b"".join(table.column(c).take(rows).to_pylist()), dtype)
    node, gram = np.repeat(get("nodes", np.int64), get("counts", np.uint32)), get("grams", np.uint64)
    often = get("often", np.uint32)
    return node, gram, often if len(often) else np.ones(len(gram), np.uint32)


def met(node: np.ndarray, gram: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted by gram and node, each once: node, the least node with the same gram, gram, and how often all rows of
    the gram were met."""
    order = np.lexsort((node, gram))
    node, gram = node[order], gram[order]
    first = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.zeros(0, bool)
    once = first | np.append(True, node[1:] != node[:-1]) if len(gram) else first
    weight = np.ones(len(gram), np.int64) if often is None else often[order].astype(np.int64)
    total = np.add.reduceat(np.where(once, weight, 0), np.flatnonzero(first)) if len(gram) else weight
    node, gram, first = node[once], gram[once], first[once]
    size = np.diff(np.append(np.flatnonzero(first), len(gram)))
    return node, np.repeat(node[first], size), gram, np.repeat(total, size)


PACKED_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACKED_TYPES, strict=True)], names=["part", "nodes", "counts", "grams", "often", "done"])


def dealt(parts: int):  # noqa: ANN201
    """Prefixes to packed parts by gram. Within a batch, all but the least node of a gram are done (1): they
    are known to share it and go to parts by node; the least goes on, marked (2) if it shares it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in H.pieces(whole, "prefix", SLICE)):
            names = np.stack([np.asarray(batch.column(c)) for c in ("node", "check")])
            # sets of one name that differ all stay: their node then stands for the grams of both
            _, at = np.unique(names, axis=1, return_index=True)
            blobs = batch.column("prefix").take(pa.array(at)).to_pylist()
            node, gram = np.repeat(names[0, at], [len(x) // 8 for x in blobs]), np.frombuffer(b"".join(blobs), np.uint64)
            node, head, gram, size = met(node, gram)
            part = (gram % H.U(parts)).astype(np.int64)
            alone, rest, least_ = size == 1, node != head, (size > 1) & (node == head)
            yield packed_batch([
                *pack(node[alone], gram[alone], part[alone], 0),
                *pack(node[rest], gram[rest], node[rest] % parts, 1),
                *pack(node[least_], gram[least_], part[least_], 2, size[least_]),
            ])

    return run


def sharing(table: pa.Table, parts: int) -> pa.Table:
    """Of one part: nodes with the grams they share, packed by parts of nodes, and a row (3) of the grams that were met
    FREQUENT times at least, with how often."""
    known, alone, more = (unpack(table, k) for k in (1, 0, 2))
    # rows marked 2 first, so that they stand for a node's gram
    node, gram, often = (np.concatenate([x, y]) for x, y in zip(more, alone, strict=True))
    node, head, gram, total = met(node, gram, often)
    shared, hot = total > 1, (total >= FREQUENT) & (node == head)
    rows = list(pack(np.concatenate([known[0], node[shared]]), np.concatenate([known[1], gram[shared]]), np.concatenate([known[0], node[shared]]) % parts, 0))
    if hot.any():
        rows.append((0, b"", b"", gram[hot].tobytes(), total[hot].astype(np.uint32).tobytes(), 3))
    batch = packed_batch(rows)
    H.release()
    return pa.Table.from_batches([batch])


def frequent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grams, often in zip(batch.column("grams").to_pylist(), batch.column("often").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(grams, np.int64)), pa.array(np.frombuffer(often, np.uint32).astype(np.int64))], names=["gram", "often"]
            )


def frequent_grams(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_FREQUENT of the most frequent grams, sorted, and the rank of each. Any part of them would do, as long as
    all nodes order their grams by the same: what is not in it just is not left out.

    How many grams are met how often, in steps of an eighth, says from where on there are few enough; only those come here.
    """
    rows = shared.where("done = 3").select("grams", "often").mapInArrow(frequent_rows, "gram long, often long")
    step = F.floor(F.log2(F.col("often").cast("double")) * 8).cast("int")
    steps = rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # 512 at most
    total, least_ = 0, None
    for r in steps:
        total += r.n
        if total > MOST_FREQUENT:
            break
        least_ = r.step
    got = rows.where(step >= least_ if least_ is not None else F.lit(False)).toArrow()
    gram, often = np.asarray(got.column("gram")).view(np.uint64), np.asarray(got.column("often"))
    gram = gram[np.lexsort((gram, -often))]
    order = np.argsort(gram)
    return gram[order], order.astype(np.int32)


def left_over(table: pa.Table) -> pa.Table:
    """Of one part of nodes: each node's shared grams."""
    node, gram, _ = unpack(table, 0)
    order = np.lexsort((gram, node))
    node, gram = node[order], gram[order]
    once = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])) if len(gram) else np.zeros(0, bool)
    node, gram = node[once], gram[once]
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(node))
    H.release()
    return pa.table({
        "node": pa.array(node[head], pa.int64()),
        "n": pa.array((ends - head), pa.int64()),
        "grams": pa.array([gram[a:b].tobytes() for a, b in zip(head, ends, strict=True)], pa.binary()),
    })


def joining(batches: Iterator[pa.RecordBatch], parts: int, frequent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Shared grams of the nodes left, without each node's most frequent, to packed parts; edges to the
    least node of the slice are done."""
    hot, rank = frequent.value
    for batch in (x for whole in batches for x in H.pieces(whole, "grams", SLICE)):
        nodes, blobs = [], []
        for name, size, grams in zip(*(batch.column(c).to_pylist() for c in ("node", "size", "grams")), strict=True):
            gram = np.frombuffer(grams, np.uint64)
            if len(hot) and needed(size) > 1:
                back = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
                place = np.where(hot[back] == gram, rank[back], len(hot))
                out = np.argsort(place, kind="stable")[: needed(size) - 1]
                gram = np.delete(gram, out[place[out] < len(hot)])
            nodes.append(np.full(len(gram), name))
            blobs.append(gram)
        if not nodes:
            continue
        node, head, gram, _ = met(np.concatenate(nodes), np.concatenate(blobs))
        edge = np.unique(np.stack([head[node != head], node[node != head]]), axis=1)
        least_ = node == head
        rows = list(pack(node[least_], gram[least_], (gram[least_] % H.U(parts)).astype(np.int64), 0))
        if edge.shape[1]:
            rows.append((int(edge[1][0] % parts), edge[0].tobytes(), b"", edge[1].tobytes(), b"", 1))
        yield packed_batch(rows)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges: the least node that each other node reaches by them, and that node."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root, before = at[: len(u)], at[len(u) :], np.arange(len(names)), None
    while before is None or (before != root).any():
        before, low = root.copy(), np.minimum(root[a], root[b])
        for side in (a, b, before[a], before[b]):
            np.minimum.at(root, side, low)
        root = root[root]
    other = root != np.arange(len(names))
    return names[root[other]], names[other]


def edges_of(table: pa.Table) -> pa.Table:
    """Of one part: each node with the least that it reaches by the part's grams and edges."""
    done = np.asarray(table.column("done"))
    take = lambda c, which: table.column(c).take(pa.array(np.flatnonzero(which))).to_pylist()
    known = np.stack([np.frombuffer(b"".join(take(c, done == 1)), np.int64) for c in ("nodes", "grams")])
    node, head, _, _ = met(*unpack(table, 0)[:2])
    u, v = stars(np.concatenate([known[0], head[node != head]]), np.concatenate([known[1], node[node != head]]))
    H.release()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none."""
    each = edges.select(F.col("u").alias("k"), F.lit(1).alias("top"), F.lit(0).alias("low"))
    each = each.unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("top"), F.lit(1).alias("low")))
    count = each.groupBy("k").agg(F.max("top").alias("top"), F.sum("low").alias("low"))
    return count.where("low > 1 or (top > 0 and low > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable by the edges (u, v); alternating large and small stars.

    Each round joins the edges with the least neighbour of each node, found with a map-side combine; the
    edges are written to the shared folder each round (and those of the round before deleted), and the driver sees
    only whether they are settled. Rounds end when all edges are stars, which they are after about the logarithm of
    the longest path squared.
    """
    edges, path = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while not settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("m").alias("u"), "v").unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
        small = small.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        before = path
        edges, path = written(small.distinct(), "edges")
        discard(edges.sparkSession, [before])
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


class Classes:
    """Which sets are known to be linked, directly or not; the smaller class takes the larger one's number."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def link(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        x, y = (self.members.pop(k, [k]) for k in (a, b))
        if len(x) < len(y):
            a, x, y = b, y, x
        self.of[y] = a
        x += y
        self.members[a] = x


class Trie:
    """The heads of sets, sorted, as nodes numbered in depth-first order: each with its token, depth, the sets
    below it (places first to last - 1), and the least and most size and the most length below it."""

    def __init__(self, heads: list[tuple[int, ...]], size: np.ndarray, length: np.ndarray) -> None:
        token, depth, first, last, low, high, long = [], [], [], [], [], [], []
        open_: list[int] = []
        self.path: list[list[int]] = []

        def close(to: int, at: int) -> None:
            while len(open_) > to:
                v = open_.pop()
                last[v] = at
                if open_:
                    p = open_[-1]
                    low[p], high[p], long[p] = min(low[p], low[v]), max(high[p], high[v]), max(long[p], long[v])

        for i, head in enumerate(heads):
            common = 0
            while common < len(open_) and common < len(head) and token[open_[common]] == head[common]:
                common += 1
            close(common, i)
            s, n = int(size[i]), int(length[i])
            if open_:
                p = open_[-1]
                low[p], high[p], long[p] = min(low[p], s), max(high[p], s), max(long[p], n)
            self.path.append(list(range(len(token), len(token) + len(head) - common)))
            for d in range(common, len(head)):
                open_.append(len(token))
                for column, x in zip((token, depth, first, last, low, high, long), (head[d], d, i, 0, s, s, n), strict=True):
                    column.append(x)
        close(0, len(heads))
        self.token, self.depth, self.first, self.last, self.low, self.high, self.long = (
            np.array(c, np.int64) for c in (token, depth, first, last, low, high, long)
        )

    def uniform(self, of: np.ndarray) -> np.ndarray:
        """Whether all sets below a node are of one class."""
        change = np.append(0, np.cumsum(of[1:] != of[:-1]))
        return change[self.first] == change[self.last - 1] if len(self.first) else np.zeros(0, bool)


def trie_links(sets: list[np.ndarray], own: np.ndarray | None = None, band: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, enough of them to connect all that are linked.

    own: pairs of two sets that are not own don't count; band: where there are two, only pairs across count.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, code, df = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    # the order: rare grams first; grams that one set alone has can't overlap and stay out
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    use = df[code] > 1
    by = np.lexsort((rank[code[use]], owner[use]))
    tokens, owner = rank[code[use]][by], owner[use][by]
    cut = np.searchsorted(owner, np.arange(m + 1))
    # a head: beyond it, two sets that meet for the first time can't reach the overlap that any link needs
    head = np.maximum(0, np.diff(cut) + (-NUM * size // DEN) + 1)
    rows = [tokens[cut[i] : cut[i + 1]] for i in range(m)]
    heads = [tuple(r[:h].tolist()) for r, h in zip(rows, head.tolist(), strict=True)]
    order = sorted(np.flatnonzero(head > 0).tolist(), key=heads.__getitem__)
    if len(order) < 2:
        return []
    heads, rows, size = [heads[i] for i in order], [rows[i] for i in order], size[order]
    length = np.array([len(r) for r in rows], np.int64)
    rest = length - np.array([len(h) for h in heads])
    end = np.array([h[-1] for h in heads], np.int64)
    own = np.ones(len(order), bool) if own is None else own[order]
    band = np.zeros(len(order), np.int64) if band is None else band[order]
    across, m = band.min() != band.max(), len(order)
    trie, classes, links = Trie(heads, size, length), Classes(len(order)), []

    def try_link(i: int, j: int) -> None:
        x, y = (rows[i], rows[j]) if length[i] < length[j] else (rows[j], rows[i])
        same = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
        if DEN * same >= NUM * (size[i] + size[j] - same):
            classes.link(i, j)
            links.append((order[i], order[j]))

    def counts(i, j):  # noqa: ANN001, ANN202
        """Whether pairs count and are not linked yet."""
        ok = (own[i] | own[j]) & (classes.of[i] != classes.of[j])
        return ok & (band[i] != band[j]) if across else ok

    # postings: of each token its nodes, in depth-first order; a node's own place in them
    back = np.argsort(trie.token, kind="stable")
    new = np.append(True, trie.token[back[1:]] != trie.token[back[:-1]])
    begin, place = np.empty(len(back), np.int64), np.empty(len(back), np.int64)
    begin[back], place[back] = np.maximum.accumulate(np.where(new, np.arange(len(back)), 0)), np.arange(len(back))
    # neighbours first, in the trie and along each token's nodes: most of what is linked then is of one class
    near = np.concatenate([np.stack([np.arange(1, m), np.arange(m - 1)]), trie.first[np.stack([back[1:], back[:-1]])][:, ~new[1:]]], axis=1)
    near = np.unique(near.max(0) * m + near.min(0))
    near = np.stack([near // m, near % m])
    near = near[:, counts(*near) & (DEN * size[near].min(0) >= NUM * size[near].max(0))]
    for i, j in near.T.tolist():
        if classes.of[i] != classes.of[j]:
            try_link(i, j)
    flat = trie.uniform(classes.of)
    cut = np.append(0, np.cumsum([len(p) for p in trie.path]))  # nodes are numbered by set
    reach = place - begin + 1
    work = np.append(0, np.cumsum(reach))[cut]
    touched: list[np.ndarray] = []
    done = 0
    for i in range(m):
        if i >= done:  # a block of sets: what their new nodes meet, up to themselves, as the others meet them from their side
            start, done = i, max(i + 1, int(np.searchsorted(work, work[i] + BLOCK, "right")) - 1)
            v = np.arange(cut[start], cut[done])
            v = v[(reach[v] > 1) | (trie.last[v] - trie.first[v] > 1)]
            n = reach[v]
            w = back[np.repeat(begin[v] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            v = np.repeat(v, n)
            p, q = trie.depth[v], trie.depth[w]
            most = np.minimum(p, q) + np.minimum(trie.long[v] - p, trie.long[w] - q)
            stays = (NUM + DEN) * most >= NUM * (trie.low[v] + trie.low[w])
            stays &= (DEN * trie.high[w] >= NUM * trie.low[v]) & (DEN * trie.high[v] >= NUM * trie.low[w])
            stays &= ~(flat[v] & flat[w] & (classes.of[trie.first[v]] == classes.of[trie.first[w]]))
            v, w = v[stays], w[stays]  # the other subtrees are cut
            n = trie.last[w] - trie.first[w]
            met_ = np.repeat(trie.first[w] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            split = np.searchsorted(np.repeat(v, n), np.arange(cut[start], cut[done] + 1))
        fresh = trie.path[i]
        del touched[len(heads[i]) - len(fresh) :]
        touched += [met_[split[v - cut[start]] : split[v - cut[start] + 1]] for v in fresh]
        found = np.concatenate(touched)
        if not len(found):
            continue
        found, overlap = np.unique(found, return_counts=True)
        ok = (found < i) & counts(i, found)
        found, overlap = found[ok], overlap[ok]
        more = np.where(end[i] <= end[found], rest[i], rest[found])
        ok = (NUM + DEN) * (overlap + more) >= NUM * (size[i] + size[found])
        found, overlap = found[ok], overlap[ok]
        for j in found[np.argsort(-overlap, kind="stable")].tolist():
            if classes.of[i] != classes.of[j]:
                try_link(i, j)
    return links


def trie_group(table: pa.Table) -> pa.Table:
    """Of one task: each set with the least set (u) that the links it holds connect it with."""
    sets, own, band = (np.asarray(table.column(c)) for c in ("set", "own", "band"))
    _, once = np.unique(sets, return_index=True)  # a doc_id that repeats brings its set again
    sets, own, band = sets[once], own[once], band[once]
    found = trie_links([np.frombuffer(x, np.uint64) for x in table.column("grams").take(pa.array(once)).to_pylist()], own, band)
    pairs = np.array(found, np.int64).reshape(-1, 2)
    u, v = stars(sets[pairs[:, 0]], sets[pairs[:, 1]])
    H.release()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def full_sets(n: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.pieces(whole):
                # a text of another set, should two that share a doc_id also share a hash, is not taken for it
                names = zip(batch.column("node").to_pylist(), batch.column("check").to_pylist(), strict=True)
                blobs = [s.tobytes() if len(s) and names_of(s) == k else None for s, k in zip(sets_of(batch, n), names, strict=True)]
                keep = [batch.column(c) for c in ("set", "root", "places")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(blobs, pa.binary())], names=["set", "root", "places", "grams"])

    return run


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash: rows that share a doc_id, or have none, are told apart by their texts."""
    return documents(docs).withColumn("text_hash", F.xxhash64("text"))


def shingle_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null: empty set), prefix; a table in the shared folder."""
    return materialise(hashed(docs).mapInArrow(set_rows(n), SETS), "sets")


def candidate_groups(sets: DataFrame) -> DataFrame:
    """node, root: groups of nodes that may be linked; linked nodes are in one group."""
    spark = sets.sparkSession
    full = sets.where(F.col("node").isNotNull()).select("node", "check", "n_shingles", "prefix")
    entries = full.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries // GROUP_ENTRIES) + 1)
    shared = materialise(full.mapInArrow(dealt(parts), PACKED).groupBy("part").applyInArrow(lambda t: sharing(t, parts), PACKED), "shared")
    frequent = spark.sparkContext.broadcast(frequent_grams(shared))  # MOST_FREQUENT at most
    sizes = full.groupBy("node").agg(F.min("n_shingles").alias("size"))
    least_ = F.ceil(F.col("size") * NUM / DEN)
    level_ = F.greatest(F.lit(1), F.least(F.floor(least_ / 4), F.lit(62)), F.floor(least_ / 10))  # needed()
    left = (
        shared.where("done = 0").groupBy("part").applyInArrow(left_over, "node long, n long, grams binary")
        .join(sizes, "node").where(F.col("n") >= level_)
    )
    left = materialise(left.select("node", "size", "grams"), "left")
    edges = left.mapInArrow(lambda b: joining(b, parts, frequent), PACKED).groupBy("part").applyInArrow(edges_of, "u long, v long")
    return components(edges)


def named_sets(sets: DataFrame) -> DataFrame:
    """node, check, rep, n, row_id, row_hash: each set that is not empty, the least doc_id that has it, its size, and which
    text to take for it."""
    row = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("row_id"), F.col("text_hash").alias("row_hash"))
    reps = sets.where(F.col("node").isNotNull()).groupBy("node", "check").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min(row).alias("row")
    )
    return reps.select("node", "check", "rep", "n", "row.*")


def texts_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """chosen, which has ROW, with the text of each row. Of rows with equal id and text one goes on: a set has one text,
    whatever repeats. The same plan for any number of sets: these grow with the input."""
    id_ = F.coalesce("doc_id", F.lit(-(2**63))).alias("row_id")
    text = hashed(docs).select(id_, F.col("text_hash").alias("row_hash"), "text").groupBy(*ROW).agg(F.first("text").alias("text"))
    return text.join(chosen.hint("merge"), ROW)


def dealt_tasks(groups: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """root, class, a, b, set, own, band, grams: the sets that each task's trie holds.

    A group of at most TASK_ENTRIES is one task. A larger one has a task per size class (powers of 1 / t), with
    the next class beside it, whose sets (not own) are linked among themselves elsewhere; so a set is in two
    tasks. A class too large is cut into bands by hash, and each pair of bands is a task.
    """
    whole = groups.groupBy("root").agg((F.sum("n") > TASK_ENTRIES).alias("large"))
    level_ = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    placed = groups.join(whole, "root").withColumn("size", F.when(F.col("large"), level_).otherwise(0))
    both = F.when(F.col("large"), F.array(F.col("size"), F.col("size") - 1)).otherwise(F.array(F.lit(0)))
    placed = placed.withColumn("class", F.explode(both))
    bands = placed.groupBy("root", "class").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / TASK_ENTRIES)).cast("int").alias("bands"))
    placed = placed.join(bands, ["root", "class"])
    where = F.struct("class", "bands", (F.col("size") == F.col("class")).alias("own"))
    chosen = placed.groupBy("set", "root", "node", "check", *ROW).agg(F.collect_list(where).alias("places"))
    text = texts_of(chosen, docs)
    keys = ["node", "check", "set", "root", "places"]
    grams = text.select(*keys, "text").mapInArrow(
        full_sets(n), "set long, root long, places array<struct<class:int,bands:int,own:boolean>>, grams binary"
    )
    tasks = grams.where(F.col("grams").isNotNull()).withColumn("place", F.explode("places")).select("set", "root", "grams", "place.*")
    tasks = tasks.withColumn("band", F.pmod(F.xxhash64("set"), F.col("bands")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    return tasks.withColumns({"a": F.least("band", "other"), "b": F.greatest("band", "other")}).drop("other", "bands")


def jaccard_join(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document.

    A set is the distinct n-word grams of the text with A-Z lower-cased (words: runs without space and
    \\x09-\\x0D); with fewer words, the whole sequence as one; a null or empty text or one without words
    has an empty set, and is linked with nothing. Documents link when 5 * intersection >= 4 * union.
    component_id is the smallest doc_id reachable by links, itself included.
    Rows with a null doc_id take part; a class of such rows only has a null component_id. Rows that repeat
    are linked. An empty table gives no rows; other columns are not read.
    """
    sets = shingle_sets(docs, n)
    names = ["node", "check"]
    reps = named_sets(sets)
    groups = candidate_groups(sets).join(reps, "node").withColumn("set", F.monotonically_increasing_id())
    groups = materialise(groups, "groups")
    tasks = dealt_tasks(groups, docs, n)
    links = tasks.groupBy("root", "class", "a", "b").applyInArrow(lambda t: trie_group(t), "u long, v long")
    classes = components(links).withColumnRenamed("node", "set").join(groups.select("set", *names, "rep"), "set")
    least_ = classes.groupBy("root").agg(F.min("rep").alias("least"))
    named = classes.join(least_, "root").select(*names, "least")
    marked = reps.join(named, names, "left").select(*names, F.coalesce("least", "rep").alias("least"))
    out = sets.drop("prefix", "text_hash").join(marked, names, "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, n: int = N) -> DataFrame:
    """The documents, with all their columns, without near copies: one row of each class stays, that with the
    smallest doc_id (a null one only where the class has no other; of equal ones any).

    Rows are told apart by a number of their own in a written table, so that rows which share a doc_id, or
    have none, stay or go by their own text. Texts without words are linked with nothing and stay. An empty table gives no rows.
    """
    # the documents' columns within one, so that no name of theirs is taken
    rows = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("__row")), "rows")
    linked = jaccard_join(rows.select(F.col("__row").alias("doc_id"), F.col("doc.text").alias("text")), n)
    linked = materialise(linked.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__class")), "linked")
    # a class that is one row has nothing to lose
    several = linked.groupBy("__class").agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select("__class")
    placed = materialise(linked.join(several, "__class").join(rows.select("__row", "doc.doc_id"), "__row"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    stays = placed.groupBy("__class").agg(F.min(order)["__row"].alias("__row"))
    gone = placed.select("__row").join(stays.select("__row"), "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select("doc.*")


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
sides AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least_of AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
