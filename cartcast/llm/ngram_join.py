"""N-gram Jaccard join with count-vector R-trees.

A document is its set of distinct word shingles, each a 64-bit hash. Hashing a
set's shingles into groups and counting per group makes it a point; two sets
share at most the sum over groups of the smaller count, and two boxes of an
R-tree at most the sum of the smaller upper corners. A join descends pairs of
boxes whose bound (and size range) still allows the threshold, down to points;
the pairs left are verified by exact intersection.

To spread this over a cluster, shingles are ordered from rare to frequent (by
the document counts of their hashed groups over all documents). A set with
``n`` shingles cannot share ``t * n`` of them with another unless the two have
one of their first ``n - ceil(t n) + 1`` in common, so the points that share
such a shingle are joined among themselves, bucket by bucket. Points whose
bound allows a link are tied; what is tied forms a cluster, and each cluster is
joined once more, now with its sets, by an R-tree in one task, or, if it is
large, in blocks whose pairs are tasks. Equal sets are one point. No pair is
ever emitted: a task returns a link count per point and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartcast.llm.common import (
    HOT_LEAST,
    HOT_PARTS,
    LINKS,
    SMALL_ROWS,
    attach,
    link_rows,
    staged,
    with_small_side,
)
from cartcast.llm.components import components
from cartcast.llm.words import FOLD, NOT_SPACE, blocks, find_words, mix, ngram_hash

SHINGLE = 3
PERCENT = 90  # links have 100 * intersection >= PERCENT * union
GROUP_BITS = 19  # groups whose document counts order the shingles
LEAF = 32  # points of a leaf
FANOUT = 8  # boxes of an inner box
MASS = 1 << 20  # shingles joined in one task
GROUPS = 256  # of the points that buckets are joined by
BUCKET = 4096  # points of a bucket joined by its own R-tree
TASK_ROWS = 40_000  # bucket members handled by one task


def text_sets(texts: pa.Array, shingle: int, order: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than ``shingle`` make one, none make none.

    With ``order``, the rank of each group, a shingle's key is its group's rank
    followed by the hash's other bits: a permutation of the hashes under which
    sorting goes from rare groups to frequent ones.
    """
    mask = np.uint64((1 << GROUP_BITS) - 1)
    for block in blocks(texts):
        words = find_words(block, NOT_SPACE, FOLD)
        doc, h = ngram_hash(words, shingle)
        short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
        if len(short):
            ends = np.append(0, np.cumsum(words.counts))
            whole = np.zeros(len(short), np.uint64)
            for i, d in enumerate(short):
                for w in words.hash[ends[d] : ends[d + 1]]:
                    whole[i] = mix((whole[i : i + 1] ^ w) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(17))[0]
            at = np.searchsorted(doc, short)
            doc, h = np.insert(doc, at, short), np.insert(h, at, whole)
        if order is not None:
            h = order[(h & mask).astype(np.int64)].astype(np.uint64) << np.uint64(64 - GROUP_BITS) | h >> np.uint64(GROUP_BITS)
        cuts = np.searchsorted(doc, np.arange(block.n + 1)).tolist()
        for i in range(block.n):
            yield np.unique(h[cuts[i] : cuts[i + 1]])


def set_digest(keys: np.ndarray) -> int:
    """Signed 64-bit digest of a set of hashes, in whatever order."""
    return int(mix(np.add.reduce(mix(keys), keepdims=True) + np.uint64(len(keys))).view(np.int64)[0])


def group_point(keys: np.ndarray, groups: int) -> np.ndarray:
    """How many of a set's hashes fall into each of ``groups`` groups."""
    return np.bincount((mix(keys) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def survey(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc, n, node, point) of every document, and one row per task (n -1) of group document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << GROUP_BITS, np.int64)
        mask = np.uint64((1 << GROUP_BITS) - 1)
        names, some = ["doc", "n", "node", "point"], False
        for batch in batches:
            sizes, nodes, points, pending, held = [], [], [], [], 0
            for keys in text_sets(batch.column(1), shingle):
                sizes.append(len(keys))
                nodes.append(set_digest(keys) if len(keys) else None)
                points.append(np.minimum(group_point(keys, GROUPS), 0xFFFF).astype(np.uint16).tobytes())
                pending.append(keys)
                held += len(keys)
                if held > 1 << 18:
                    counts += np.bincount((np.concatenate(pending) & mask).astype(np.int64), minlength=len(counts))
                    pending, held = [], 0
            if pending:
                counts += np.bincount((np.concatenate(pending) & mask).astype(np.int64), minlength=len(counts))
            some = True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary())], names
            )
        if some:
            # Counts only order the shingles, so they may saturate.
            small = np.minimum(counts, 0xFFFF).astype(np.uint16).tobytes()
            row = [pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([small], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names)

    return staged(docs.mapInArrow(run, "doc long, n int, node long, point binary"), "shingle-survey")


def group_counts(surveyed: DataFrame) -> np.ndarray:
    """Document counts per group: the tasks' counts summed in parts, then over the parts; one row comes here."""

    def total_of(kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << GROUP_BITS, np.int64)
            for batch in batches:
                for row in batch.column(0):
                    total += np.frombuffer(row.as_py(), kind)
            small = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([small], pa.binary())], ["point"])

        return run

    rows = surveyed.where("n = -1").select("point")
    parts = rows.repartition(16).mapInArrow(total_of(np.uint16), "point binary")
    whole = parts.repartition(1).mapInArrow(total_of(np.uint32), "point binary").collect()
    return np.frombuffer(whole[0]["point"], np.uint32) if whole else np.zeros(1 << GROUP_BITS, np.uint32)


def prefixes(docs: DataFrame, counts: np.ndarray, copied: dict[int, int], shingle: int, percent: int) -> DataFrame:
    """Rows (shingle, node, n): the rarest shingles of every point; a written table.

    ``copied``: of very large groups of equal sets, the document that stands for them.
    """
    order = np.empty(len(counts), np.uint32)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast((order, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, copied = shared.value
        back = inverse_order(order)
        for batch in batches:
            ids, firsts, nodes, sizes = batch.column(0).to_pylist(), [], [], []
            for doc, keys in zip(ids, text_sets(batch.column(1), shingle, order)):
                if not len(keys) or doc is None:
                    continue
                node = set_digest(_unordered(keys, back))
                if copied.get(node, doc) == doc:
                    firsts.append(keys[: prefix_length(len(keys), percent)])
                    nodes.append(node)
                    sizes.append(len(keys))
            if firsts:
                times = [len(f) for f in firsts]
                columns = [
                    pa.array(np.concatenate(firsts).view(np.int64)),
                    pa.array(np.repeat(np.array(nodes, np.int64), times)),
                    pa.array(np.repeat(np.array(sizes, np.int32), times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "node", "n"])

    return staged(docs.mapInArrow(run, "shingle long, node long, n int"), "prefixes")


def ties(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all points whose bound allows a link.

    ``rows``: shingle, node, n; ``points``: node, point. The points of a bucket
    that have one of fitting size beside them are joined by an R-tree. In a
    bucket of more than ``BUCKET`` points all are tied, each to the smallest of
    its salt and those to the smallest of the bucket: that may join clusters
    that need not be, but separates none.
    """
    size = rows.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("rows"))
    size = staged(size.where("low < high").select("shingle", "rows"), "buckets")
    members = staged(attach(rows, size, ["shingle"], "rows"), "bucket-members")

    by_size = Window.partitionBy("shingle").orderBy("n", "node")
    fits = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.lead("n").over(by_size) * percent <= F.col("n") * 100)
    few = members.where(F.col("rows") <= BUCKET).withColumn("fits", fits).where("fits").select("shingle", "node", "n")
    few = staged(few, "bucket-fits")
    tasks = max(1, few.count() // TASK_ROWS)
    wide = few.join(points, "node").withColumn("task", F.pmod(F.xxhash64("shingle"), F.lit(tasks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["shingle", "node"]).sort_values(["shingle", "node"], kind="stable")
        node, size = pdf["node"].to_numpy(), pdf["n"].to_numpy(np.int64)
        point = np.frombuffer(b"".join(pdf["point"]), np.uint16).reshape(-1, GROUPS).astype(np.int32)
        point[point == 0xFFFF] = 1 << 24  # saturated: bounds nothing
        key = pdf["shingle"].to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(start, len(node)))
        two = start[length == 2]  # most buckets: one bound each
        fits = bounded(point[two], size[two], point[two + 1], size[two + 1], percent)
        edges = [(node[two[fits]], node[two[fits] + 1])]
        for at, k in zip(start[length > 2], length[length > 2]):
            own = slice(at, at + k)
            x, y = tied_points(RTree(size[own], point[own]), percent)
            edges.append((node[own][x], node[own][y]))
        return pd.DataFrame({c: np.concatenate([e[i] for e in edges]) for i, c in enumerate("ab")}).drop_duplicates()

    near = wide.select("task", "shingle", "node", "n", "point").groupBy("task").applyInPandas(run, "a long, b long")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / BUCKET))
    many = members.where(F.col("rows") > BUCKET).select("shingle", salt.alias("salt"), "node")
    low = F.min("node").over(Window.partitionBy("shingle", "salt"))
    star = many.select(F.col("node").alias("a"), low.alias("b")).where("a != b")
    lows = many.groupBy("shingle", "salt").agg(F.min("node").alias("a"))  # one row per salt
    far = lows.select("a", F.min("a").over(Window.partitionBy("shingle")).alias("b")).where("a != b")
    return near.union(star).union(far)


def bounded(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sums of smaller counts of points p, q (sizes n, m) reach what a link needs."""
    return np.minimum(p, q).sum(1) >= _needed(n, m, percent)


def tied_points(tree: RTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of points whose bound allows a link."""
    up = list(range(len(tree.rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for p, q in leaf_pairs(tree, tree, percent):
        i, j = tree.leaf_points(p), tree.leaf_points(q)
        ri, rj = tree.rows[i], tree.rows[j]
        if len({find(int(r)) for r in (*ri, *rj)}) == 1:
            continue  # all connected already
        for x, y in zip(*np.nonzero(tree.allowed(tree, i, j, percent))):
            a, b = find(int(ri[x])), find(int(rj[y]))
            if a != b:
                up[max(a, b)] = min(a, b)
    x = np.array([i for i in range(len(up)) if find(i) != i], dtype=int)
    return x, np.array([find(int(i)) for i in x], dtype=int)


def inverse_order(order: np.ndarray) -> np.ndarray:
    """The group of each rank."""
    back = np.empty(len(order), np.uint64)
    back[order.astype(np.int64)] = np.arange(len(order), dtype=np.uint64)
    return back


def _unordered(keys: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The hashes that ``keys`` were made of; ``back`` is the inverse of their order."""
    return keys << np.uint64(GROUP_BITS) | back[(keys >> np.uint64(64 - GROUP_BITS)).astype(np.int64)]


class RTree:
    """Points (group counts of sets) packed into boxes, level by level.

    Points are sorted by size, then by their counts in tiles (sort-tile-
    recursive over the groups of largest spread). ``upper[k]`` holds the upper
    corners of level ``k``; level 0 are the leaves.
    """

    def __init__(self, size: np.ndarray, counts: np.ndarray, sets: list[np.ndarray] | None = None):
        self.sets = sets
        self.rows = self._packed(size, counts)
        self.size, self.counts = size[self.rows], counts[self.rows]
        leaf = np.arange(0, len(size), LEAF)
        self.upper = [np.maximum.reduceat(self.counts, leaf)]
        self.least = [np.minimum.reduceat(self.size, leaf)]
        self.most = [np.maximum.reduceat(self.size, leaf)]
        while len(self.upper[-1]) > FANOUT:
            at = np.arange(0, len(self.upper[-1]), FANOUT)
            self.upper.append(np.maximum.reduceat(self.upper[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _packed(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        wide = np.argsort(-counts.astype(float).std(0), kind="stable")[:3]
        order = np.lexsort((counts[:, wide[0]], size))
        slab = LEAF * FANOUT
        for at in range(0, len(order), slab):  # within points of about one size, tile by the widest groups
            part = order[at : at + slab]
            part = part[np.argsort(counts[part, wide[0]], kind="stable")]
            for s in range(0, len(part), 2 * LEAF):
                strip = part[s : s + 2 * LEAF]
                part[s : s + 2 * LEAF] = strip[np.argsort(counts[strip, wide[-1]], kind="stable")]
            order[at : at + slab] = part
        return order

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], groups: int) -> RTree:
        return cls(np.array([len(s) for s in sets]), np.stack([group_point(s, groups) for s in sets]), sets)

    def allowed(self, other: RTree, i: slice, j: slice, percent: int) -> np.ndarray:
        """Which points i of this tree and j of the other may link, by their bound."""
        bound = np.minimum(self.counts[i, None, :], other.counts[None, j, :]).sum(2)
        return bound >= _needed(self.size[i, None], other.size[None, j], percent)

    def leaf_points(self, leaf: int) -> slice:
        return slice(leaf * LEAF, min((leaf + 1) * LEAF, len(self.rows)))

    def membership(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a leaf's sets, and which set has which."""
        if leaf not in self.known:
            sets = [self.sets[r] for r in self.rows[self.leaf_points(leaf)]]
            words, code = np.unique(np.concatenate(sets), return_inverse=True)
            has = np.zeros((len(sets), len(words)), np.uint8)
            has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), code] = 1
            self.known[leaf] = words, has
        return self.known[leaf]


def _needed(a, b, percent: int):
    """Smallest intersection with which sets of these sizes link: 100 i >= p (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def leaf_pairs(one: RTree, two: RTree, percent: int) -> list[tuple[int, int]]:
    """Pairs of leaves whose boxes may hold a link; with ``one is two`` each pair once."""
    level_one, level_two = len(one.upper) - 1, len(two.upper) - 1
    a, b = (m.ravel() for m in np.meshgrid(np.arange(len(one.upper[-1])), np.arange(len(two.upper[-1])), indexing="ij"))
    while True:
        if one is two:
            a, b = a[a <= b], b[a <= b]
        keep = []
        for at in range(0, len(a), 4096):
            i, j = a[at : at + 4096], b[at : at + 4096]
            bound = np.minimum(one.upper[level_one][i], two.upper[level_two][j]).sum(1)
            least = _needed(one.least[level_one][i], two.least[level_two][j], percent)
            fits = (100 * one.most[level_one][i] >= percent * two.least[level_two][j]) & (
                100 * two.most[level_two][j] >= percent * one.least[level_one][i]
            )
            keep.append((bound >= least) & fits)
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        if level_one == 0 and level_two == 0:
            return list(zip(a.tolist(), b.tolist()))
        if level_one >= level_two:
            a, b = _children(a, b, len(one.upper[level_one - 1]))
            level_one -= 1
            if one is two:  # both sides go down together
                b, a = _children(b, a, len(two.upper[level_two - 1]))
                level_two -= 1
        else:
            b, a = _children(b, a, len(two.upper[level_two - 1]))
            level_two -= 1


def _children(box: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (box[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(other, FANOUT)
    return child[child < n], other[child < n]


def tree_links(one: RTree, two: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (set of one, set of two), in batches; with ``one is two`` each pair once."""
    for p, q in leaf_pairs(one, two, percent):
        i, j = one.leaf_points(p), two.leaf_points(q)
        need = _needed(one.size[i, None], two.size[None, j], percent)
        maybe = one.allowed(two, i, j, percent)
        if one is two and p == q:
            maybe &= np.arange(len(maybe))[:, None] < np.arange(maybe.shape[1])[None, :]
        x, y = np.nonzero(maybe)
        if not len(x):
            continue
        ri, rj = one.rows[i], two.rows[j]
        if len(x) <= 8:
            both = np.array([len(np.intersect1d(one.sets[ri[u]], two.sets[rj[v]], assume_unique=True)) for u, v in zip(x, y)])
        else:
            (wa, ha), (wb, hb) = one.membership(p), two.membership(q)
            _, ca, cb = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
            both = np.zeros(len(x), np.int64)
            if len(ca):
                shared = ha[:, ca].astype(np.float32) @ hb[:, cb].astype(np.float32).T
                both = shared[x, y].astype(np.int64)
        link = both >= need[x, y]
        if link.any():
            yield ri[x[link]], rj[y[link]]


def join_sets(
    nodes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, two: bool, percent: int
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked copies per point, and forest edges, within a block or (``two``) between two blocks."""
    mean = sum(map(len, sets)) / max(1, len(sets))
    groups = int(min(1024, max(16, 2 ** np.ceil(np.log2(max(1.0, mean / 8))))))
    n = len(sets)
    counts, up = np.zeros(n, np.int64), list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if two:
        parts = [np.flatnonzero(side == s) for s in (0, 1)]
        if not len(parts[0]) or not len(parts[1]):
            return counts, []
        trees = [RTree.of_sets([sets[i] for i in part], groups) for part in parts]
        found = ((parts[0][x], parts[1][y]) for x, y in tree_links(trees[0], trees[1], percent))
    else:
        tree = RTree.of_sets(sets, groups)
        found = tree_links(tree, tree, percent)
    for x, y in found:
        counts += np.bincount(x, copies[y], n).astype(np.int64) + np.bincount(y, copies[x], n).astype(np.int64)
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = find(i), find(j)
            if a != b:
                up[max(a, b)] = min(a, b)
    return counts, [(int(nodes[i]), int(nodes[find(i)])) for i in range(n) if find(i) != i]


def cluster_links(docs: DataFrame, members: DataFrame, shingle: int, percent: int, mass: int) -> DataFrame:
    """Rows (node, n, other) of all clusters: link counts (other null) and forest edges (n 0).

    ``members``: root, node, doc, copies, n. Small clusters share tasks; a
    cluster of more than ``mass`` shingles is dealt into blocks, and each pair
    of its blocks is a task.
    """
    size = members.groupBy("root").agg(F.sum(F.col("n").cast("long")).alias("mass"), F.count(F.lit(1)).alias("points"))
    size = staged(size.withColumn("parts", F.ceil(F.col("mass") / mass).cast("int")), "cluster-sizes")
    total = size.agg(F.sum("mass")).first()[0] or 0
    tasks = max(1, -(-2 * total // mass))
    placed = attach(members, size.select("root", "parts", "points"), ["root"], "points").select(
        "doc", "node", "copies", "root", "parts", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int").alias("part")
    )
    placed = staged(placed, "cluster-members")
    rows = with_small_side(docs, placed.select("doc", "node", "copies", "root", "parts", "part"), ["doc"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(text_sets(batch.column("text"), shingle))
            # A repeated id may have another text as well; only the set that was clustered counts.
            right = [len(s) > 0 and set_digest(s) == n for s, n in zip(sets, batch.column("node").to_pylist())]
            cols = [batch.column(c) for c in ("node", "copies", "root", "parts", "part")]
            out = pa.RecordBatch.from_arrays(
                [*cols, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "copies", "root", "parts", "part", "keys"]
            )
            yield out.filter(pa.array(right, pa.bool_()))

    fields = "node long, copies long, root long, parts int, part int, keys binary"
    sets = rows.select("node", "copies", "root", "parts", "part", "text").mapInArrow(collect, fields)
    # Small clusters: a task by hash of the cluster. Large ones: a task for each pair of blocks.
    blocks_of = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, F.col("part")).alias("a"), F.greatest(k, F.col("part")).alias("b")),
    )
    dealt = sets.withColumn("pair", F.explode(blocks_of)).withColumn(
        "task", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root"))
    )
    dealt = dealt.select(
        "task", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "parts", "root", "part", "node", "copies", "keys"
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, a, b, _ = key
        out = [link_rows(np.zeros(0, np.int64), np.zeros(0), [])]
        for _, own in pdf.drop_duplicates(["root", "node", "part"]).groupby("root", sort=False):
            if len(own) < 2:
                continue
            node = own["node"].to_numpy()
            sets = [np.frombuffer(k, np.uint64) for k in own["keys"]]
            side = (own["part"].to_numpy() == b).astype(int)
            out.append(link_rows(node, *join_sets(node, own["copies"].to_numpy(float), sets, side, a != b, percent)))
        return pd.concat(out, ignore_index=True)

    return dealt.groupBy("task", "a", "b", "parts").applyInPandas(run, LINKS)


def jaccard_links(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    mass: int = MASS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), n_links.

    A-Z count as a-z. A text without words (or null) has no shingles and links
    with nothing, nor do rows with a null id, whose component is null. Equal
    sets link; rows repeating id and text are copies of each other. Other
    columns are ignored, and an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    surveyed = survey(texts, shingle)
    rows = surveyed.where("n >= 0")
    points = rows.where("node IS NOT NULL AND doc IS NOT NULL").groupBy("node").agg(
        F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")
    )
    points = staged(points, "shingle-points")
    total = points.agg(F.sum("copies")).first()[0] or 0
    limit = max(total // HOT_PARTS, HOT_LEAST)
    copied = {r["node"]: r["doc"] for r in points.where(F.col("copies") > limit).select("node", "doc").collect()}  # < HOT_PARTS

    firsts = prefixes(texts, group_counts(surveyed), copied, shingle, percent)
    vectors = rows.join(points.select("node", "doc"), ["node", "doc"]).select("node", "point")
    members = components(ties(firsts, vectors, percent)).join(points, "node")
    found = staged(cluster_links(texts, staged(members, "clusters"), shingle, percent, mass), "shingle-links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = staged(groups.join(points.select("node", "doc"), "node"), "shingle-groups")
    smallest = groups.groupBy("root").agg(F.min("doc").alias("component"), F.count(F.lit(1)).alias("points"))
    groups = attach(groups, staged(smallest, "shingle-roots"), ["root"], "points").select("node", "component")
    known = points.join(groups, "node", "left").join(counts, "node", "left").select(
        "node",
        "copies",
        F.coalesce("component", "doc").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    known = staged(known, "shingle-known")
    named = rows.where("node IS NOT NULL AND doc IS NOT NULL")
    alone = rows.where("node IS NULL OR doc IS NULL")
    cols = [F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links"]
    return attach(named, known, ["node"], "copies").select(*cols).unionByName(
        alone.withColumns({"component_id": F.col("doc"), "n_links": F.lit(0).cast("long")}).select(*cols)
    )


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their component, all columns kept.

    Documents with a null id stay. Rows repeating an id go or stay together.
    """
    found = staged(jaccard_links(docs, shingle, percent, id_col, text_col), "component-of")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__nj_id")).distinct()
    gone = staged(gone, "dropped-ids")
    side = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone
    return docs.join(side, F.col(id_col).cast("long") == F.col("__nj_id"), "left_anti")
