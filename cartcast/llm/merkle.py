"""Merkle manifest of a dataset as a postorder append log.

Every row is a leaf; the leaves of one language make a tree in which each two
consecutive nodes become their digest (a last odd one its own), and the roots of
the languages make one more tree, the forest.

A tree is built by *aligned builders*: one task per block of ``2^bits`` leaves
that starts at a multiple of ``2^bits``. It appends nodes as they are completed,
so a block's nodes are one run of the tree's postorder log, and where a node lies
follows from subtree sizes alone: ``2 L - popcount(L)`` nodes are complete before
leaf ``L`` (``nodes_before``), and a subtree is closed by its root. The roots of
the blocks are the leaves of the next tier, until one block is left; each tier
has ``2^bits`` times fewer rows. Proofs are read the other way, from the forest
down: a block knows the path above it, finds the siblings inside its run by their
positions, and hands each of its children their path. A block meets its path
one to one, so no node that many proofs share becomes a hot key, and no task
holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartcast.llm.common import crc32_bucket, staged

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT, NONE = 0, 1, 2  # where the sibling of a step stands
STEP = 33  # bytes of a step: side, digest

_ABOVE = "path binary, subroot binary"
_TREE, _IDX, _M, _BLOCK, _DIGEST, _AT, _PART = (f"__mk_{c}" for c in ("tree", "idx", "m", "block", "digest", "at", "part"))


def node(*children: bytes) -> bytes:
    """Digest of the hex text of the children's digests, in order."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def nodes_before(leaf):
    """How many nodes a postorder log holds when leaf ``leaf`` (number or array) is appended."""
    return 2 * leaf - np.bitwise_count(np.asarray(leaf, np.uint64)).astype(np.int64)


def position(level: int, index, n: int):
    """Place in the log of node ``index`` of ``level`` in a tree of ``n`` leaves."""
    first = np.asarray(index, np.int64) << level
    covered = np.minimum(n - first, 1 << level)
    size = sum(-(-covered // (1 << j)) for j in range(level + 1))
    return nodes_before(first) + size - 1


def postorder(leaves: Sequence[bytes], top: int) -> list[bytes]:
    """Nodes over ``leaves`` in order of completion, up to the one node of level ``top``."""
    log: list[bytes] = []
    open_: list[tuple[int, bytes]] = []  # complete subtrees that wait for their sibling
    for leaf in leaves:
        log.append(leaf)
        level, digest = 0, leaf
        while open_ and open_[-1][0] == level:
            digest = node(open_.pop()[1], digest)
            log.append(digest)
            level += 1
        open_.append((level, digest))
    while open_ and (len(open_) > 1 or open_[-1][0] < top):
        level, digest = open_.pop()
        pair = bool(open_) and open_[-1][0] == level
        digest = node(open_.pop()[1], digest) if pair else node(digest)
        log.append(digest)
        open_.append((level + 1, digest))
    return log


def steps(run: bytes, n: int, top: int, local: np.ndarray) -> list[bytes]:
    """Steps from each leaf ``local`` of a run of ``n`` leaves up to its node of level ``top``."""
    out = [b""] * len(local)
    for level in range(top):
        mine = local >> level
        sibling = mine ^ 1
        there = (sibling << level) < n
        at = position(level, np.where(there, sibling, mine), n) * 32
        for k in range(len(local)):
            if there[k]:
                side = LEFT if mine[k] & 1 else RIGHT
                out[k] += bytes((side,)) + run[at[k] : at[k] + 32]
            else:
                out[k] += bytes((NONE,)) + bytes(32)
    return out


def siblings(path: bytes) -> list[bytes]:
    return [path[k + 1 : k + STEP] for k in range(0, len(path), STEP) if path[k] != NONE]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for k in range(0, len(path), STEP):
        other = path[k + 1 : k + STEP]
        leaf = node(leaf) if path[k] == NONE else node(other, leaf) if path[k] == LEFT else node(leaf, other)
    return leaf


def leaf_digest(values: Sequence[str | Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    parts = []
    for v in values:
        s = (F.col(v) if isinstance(v, str) else v).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _name(c: str) -> Column:
    """A key that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Written ``rows`` with their index in ``order`` within their tree and the tree's size.

    Rows are dealt by ranges of tree and order, so a large tree spans many
    tasks; only the row counts of (tree, task) are summed up in one place.
    """
    dealt = rows.repartitionByRange(_TREE, *order).sortWithinPartitions(_TREE, *order)
    dealt = staged(dealt.withColumn(_AT, F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright(_AT, 33)
    counts = dealt.groupBy(_TREE, part.alias(_PART)).agg(F.min(_AT).alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy(_TREE)
    before = F.sum("n").over(tree.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        _TREE, _PART, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias(_M)
    )
    return (
        dealt.withColumn(_PART, part)
        .join(starts, [_TREE, _PART])
        .withColumn(_IDX, F.col(_AT) + F.col("shift"))
        .drop(_PART, _AT, "shift")
    )


def _blocked(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn(_BLOCK, F.shiftright(_IDX, bits))


def _top(m: int, bits: int) -> int:
    """Levels a block of a tier adds: all of ``bits``, fewer where the block is the whole tier."""
    return bits if m > 1 << bits else height(m)


def _tiers(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """The runs of each tier, written: tree, block, number of children in tier and block, run, its last node."""
    schema = pa.schema(
        [(_TREE, pa.string()), (_BLOCK, pa.int64()), (_M, pa.int64()), ("n", pa.int64()), ("run", pa.binary()), ("last", pa.binary())]
    )

    def build(key, table):
        table = table.sort_by(_IDX)
        m = table[_M][0].as_py()
        nodes = postorder(table[_DIGEST].to_pylist(), _top(m, bits))
        row = [[key[0].as_py()], [key[1].as_py()], [m], [len(table)], [b"".join(nodes)], [nodes[-1]]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types)], schema=schema)

    ddl = f"{_TREE} string, {_BLOCK} long, {_M} long, n long, run binary, last binary"
    tiers, rows = [], leaves.select(_TREE, _IDX, _M, _DIGEST)
    while True:
        runs = staged(_blocked(rows, bits).groupBy(_TREE, _BLOCK).applyInArrow(build, ddl), f"merkle-tier-{len(tiers)}")
        tiers.append(runs)
        if (runs.agg(F.max(_M)).first()[0] or 0) <= 1 << bits:
            return tiers
        rows = runs.select(
            _TREE,
            F.col(_BLOCK).alias(_IDX),
            F.ceil(F.col(_M) / F.lit(1 << bits)).cast("long").alias(_M),
            F.col("last").alias(_DIGEST),
        )


def _descend(children: DataFrame, runs: DataFrame, paths: DataFrame, bits: int, emit, ddl: str) -> DataFrame:
    """What ``emit(children table, their paths, subroot)`` makes of each block's children.

    ``children``: tree, index and further columns; ``runs``: the tier they are
    leaves of; ``paths``: tree, block, the path above the block, and the tree's
    root, which is handed down beside it.
    """
    above = runs.select(_TREE, _BLOCK, _M, "n", "run").join(paths, [_TREE, _BLOCK])

    def run(left, right):
        left = left.sort_by(_IDX)
        block = {c: right[c][0].as_py() for c in (_BLOCK, _M, "n", "run", "path", "subroot")}
        local = left[_IDX].to_numpy() - (block[_BLOCK] << bits)
        own = steps(block["run"], block["n"], _top(block[_M], bits), local)
        return emit(left, [s + block["path"] for s in own], block["subroot"])

    keys = (_TREE, _BLOCK)
    return _blocked(children, bits).groupBy(*keys).cogroup(above.groupBy(*keys)).applyInArrow(run, ddl)


def _paths(tiers: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """Path above each block of the lowest tier; ``top`` has the path above each tree."""

    def emit(left: pa.Table, paths: list[bytes], subroot: bytes) -> pa.Table:
        whole = pa.array([subroot] * len(paths), pa.binary())
        return pa.table({_TREE: left[_TREE], _BLOCK: left[_IDX], "path": pa.array(paths, pa.binary()), "subroot": whole})

    paths = top.withColumn(_BLOCK, F.lit(0).cast("long"))
    for k in range(len(tiers) - 1, 0, -1):
        children = tiers[k - 1].select(_TREE, F.col(_BLOCK).alias(_IDX))
        paths = _descend(children, tiers[k], paths, bits, emit, f"{_TREE} string, {_BLOCK} long, {_ABOVE}")
        paths = staged(paths, f"merkle-paths-{k - 1}")
    return paths


@dataclass
class Manifest:
    """Written tables of a built manifest.

    ``leaves``: id, leaf, tampered leaf if any, with tree and index; ``tiers``
    and ``forest``: runs of the trees and of the tree over their roots;
    ``places``: each tree's place in the forest; ``root``: hex, None for no rows.
    """

    leaves: DataFrame
    tiers: list[DataFrame]
    places: DataFrame
    forest: list[DataFrame]
    root: str | None
    bits: int

    def log(self) -> DataFrame:
        """The append logs as rows: lang, position, level, digest (hex); the forest's has lang null and forest true."""
        own = _log(self.tiers, self.bits).withColumn("forest", F.lit(False))
        return own.unionByName(_log(self.forest, self.bits).withColumn("forest", F.lit(True))).select(
            F.when(F.col(_TREE) != "", F.expr(f"substring({_TREE}, 2)")).alias("lang"), "forest", "position", "level", "digest"
        )

    def proofs(self, siblings_too: bool = False) -> DataFrame:
        """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

        ``folded_root`` starts from the tampered leaf where there is one.
        ``siblings_too`` adds the proof itself: (side, digest) from leaf to root,
        side 0 or 1 for a sibling to the left or right, 2 for a node without one.
        """
        forest_paths = _paths(self.forest, _start(self.forest[0]), self.bits)
        children = self.places.select(_TREE, _IDX, _DIGEST, "lang_tree")
        above = _descend(children, self.forest[0], forest_paths, self.bits, _emit_tree, f"{_TREE} string, {_ABOVE}")
        paths = _paths(self.tiers, staged(above, "merkle-forest-paths"), self.bits)
        ddl = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
        if siblings_too:
            ddl += ", siblings array<struct<side:int,digest:string>>"
        own = _descend(self.leaves, self.tiers[0], paths, self.bits, _emitter(siblings_too), ddl)
        root = F.lit(self.root).cast("string")
        return own.select(
            "doc_id",
            "leaf",
            "subroot",
            root.alias("root"),
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == root).alias("verified"),
            *(["siblings"] if siblings_too else []),
        )


def _start(runs: DataFrame) -> DataFrame:
    return runs.select(_TREE, F.lit(b"").alias("path"), F.lit(b"").alias("subroot")).distinct()


def _emit_tree(left: pa.Table, paths: list[bytes], _: bytes) -> pa.Table:
    return pa.table({_TREE: left["lang_tree"], "path": pa.array(paths, pa.binary()), "subroot": left[_DIGEST]})


def _emitter(siblings_too: bool):
    def emit(left: pa.Table, paths: list[bytes], subroot: bytes) -> pa.Table:
        leaves, bad = left[_DIGEST].to_pylist(), left["tampered"].to_pylist()
        out = {
            "doc_id": left["doc_id"],
            "leaf": pa.array([d.hex() for d in leaves], pa.string()),
            "subroot": pa.array([subroot.hex()] * len(leaves), pa.string()),
            "proof_sha256": pa.array([node(*siblings(p)).hex() for p in paths], pa.string()),
            "folded_root": pa.array([fold(b or d, p).hex() for d, b, p in zip(leaves, bad, paths)], pa.string()),
        }
        if siblings_too:
            kind = pa.list_(pa.struct([("side", pa.int32()), ("digest", pa.string())]))
            listed = [
                [{"side": p[k], "digest": p[k + 1 : k + STEP].hex() if p[k] != NONE else None} for k in range(0, len(p), STEP)]
                for p in paths
            ]
            out["siblings"] = pa.array(listed, kind)
        return pa.table(out)

    return emit


def _expander(tier: int, bits: int):
    """Nodes of a run as rows; a higher tier's leaves lie in the tier below."""
    kinds = pa.schema([(_TREE, pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("digest", pa.string())])

    def expand(key, table):
        r = {c: table[c][0].as_py() for c in (_BLOCK, _M, "n", "run", "size")}
        at, up, digest = [], [], []
        for level in range(1 if tier else 0, _top(r[_M], bits) + 1):
            i = np.arange(-(-r["n"] // (1 << level)))
            at += position(level + tier * bits, (r[_BLOCK] << (bits - level)) + i, r["size"]).tolist()
            up += [level + tier * bits] * len(i)
            digest += [r["run"][a : a + 32].hex() for a in position(level, i, r["n"]) * 32]
        cols = [[key[0].as_py()] * len(at), at, up, digest]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.types)], schema=kinds)

    return expand


def _log(tiers: list[DataFrame], bits: int) -> DataFrame:
    """Every node of the runs by its place in its whole tree's log."""
    sizes = tiers[0].groupBy(_TREE).agg(F.max(_M).alias("size"))
    out = None
    for tier, runs in enumerate(tiers):
        part = runs.join(sizes, _TREE).groupBy(_TREE, _BLOCK)
        part = part.applyInArrow(_expander(tier, bits), f"{_TREE} string, position long, level int, digest string")
        out = part if out is None else out.unionByName(part)
    return out


def build_manifest(docs: DataFrame, bits: int = BLOCK_BITS, tampered: Column | None = None) -> Manifest:
    """Build the trees and the forest of ``docs`` (columns ``FIELDS``; others are ignored).

    Leaves ascend by doc_id, null ids first; rows of equal id by their leaf, so
    repeated rows have a defined place. Null and empty languages, texts and
    sources differ. ``tampered`` marks rows whose proof is to be tried with
    n_chars raised by 1 (a null n_chars stays).
    """
    bad = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    raised = (F.col("n_chars").cast("decimal(20,0)") + F.lit(1)).alias("n_chars")
    forged = leaf_digest([raised if c == "n_chars" else c for c in FIELDS])
    leaves = docs.select(
        _name("lang").alias(_TREE),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(FIELDS).alias(_DIGEST),
        F.when(bad, forged).alias("tampered"),
    )
    leaves = _ranked(staged(leaves, "merkle-leaves"), ["doc_id", _DIGEST])
    tiers = _tiers(leaves, bits)
    roots = tiers[-1].select(F.lit("").alias(_TREE), F.col(_TREE).alias("lang_tree"), F.col("last").alias(_DIGEST))
    places = _ranked(roots, ["lang_tree"])
    forest = _tiers(places, bits)
    root = forest[-1].select("last").first()
    return Manifest(leaves, tiers, places, forest, bytes(root["last"]).hex() if root else None, bits)


def audited_manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Proofs of every document, tried with a changed n_chars where 7 divides the id's crc32.

    One row per row of ``docs``; null ids are never changed. An empty table
    gives no rows.
    """
    return build_manifest(docs, bits, crc32_bucket("doc_id", 7) == 0).proofs()
