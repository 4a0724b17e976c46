"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, so that leading dimensions
carry the most. Vectors are dealt into tiles by intervals of the two leading
coordinates; two tiles meet only if their intervals are no further apart than
two vectors at the threshold can be. Inside a pair of tiles, blocks of vectors
are compared by their leading dimensions first; the norms of what is left of
each vector bound the rest of the product, and a block stops as soon as no pair
in it can reach the threshold. No pair of vectors is ever emitted: a task
returns a link count per vector and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.llm.common import LINKS, attach, link_rows, staged
from cartcast.llm.components import components

THRESHOLD = 0.95
TILE = 4096  # least vectors of a tile
TILE_NUMBERS = 1 << 21  # numbers of a large tile: 16 MB, so that two tiles and their copies fit a task
TILES = 64  # tiles of a table from which on they are made larger
BLOCK = 512
STEPS = (8, 16, 32)  # leading dimensions after which a block may stop
SLACK = 1e-9  # cosines this near the threshold are taken from the raw vectors


def tile_size(n: int, width: int) -> int:
    """Vectors of a tile: ``TILE``, or more in large tables as far as a task's memory goes.

    A vector is sent to about as many tasks as there are tiles it may meet, so
    larger tiles mean fewer copies of it.
    """
    return max(TILE, min(n // TILES, TILE_NUMBERS // max(1, width)))


def usable(v: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and all its components are finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct finite non-zero vectors: node (smallest id), copies, v (doubles)."""
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = fine.where(F.col("id").isNotNull() & usable(F.col("v")))
    # -0.0 and 0.0 are one value
    fine = fine.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return fine.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array(column.tolist() if isinstance(column, pd.Series) else column.to_pylist(), dtype=float)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Orthogonal axes, those of largest second moment first (columns)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["i", "s"])

    sums = nodes.select("v").mapInArrow(gram, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    g = np.zeros(width * width)
    g[sums["i"].to_numpy()] = sums["s"].to_numpy()
    g = g.reshape(width, width)
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1]


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join_all(self, rows: np.ndarray, cols: np.ndarray) -> None:
        for i, j in zip(rows.tolist(), cols.tolist()):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def linked(z: np.ndarray, raw: np.ndarray, a: slice, b: slice, suffix: np.ndarray, steps, threshold: float):
    """Pairs (rows of a, rows of b) at or above the threshold."""
    total = np.zeros((a.stop - a.start, b.stop - b.start))
    done = 0
    for k, step in enumerate(steps):
        total += z[a, done:step] @ z[b, done:step].T
        done = step
        if step < z.shape[1] and (total + np.outer(suffix[a, k], suffix[b, k])).max() < threshold - SLACK:
            return np.zeros(0, int), np.zeros(0, int)
    i, j = np.nonzero(total >= threshold - SLACK)
    near = np.abs(total[i, j] - threshold) <= SLACK
    if near.any():
        x, y = raw[a][i[near]], raw[b][j[near]]
        x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
        exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        keep = np.ones(len(i), bool)
        keep[near] = exact >= threshold
        i, j = i[keep], j[keep]
    return i + a.start, j + b.start


def compare(nodes, copies, raw, side, two, axes, threshold) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links counted per row, and forest edges, of one tile with itself or (``two``) of two tiles.

    ``side`` is 0 or 1 by tile; of two tiles only rows of different ones meet.
    """
    order = np.argsort(side, kind="stable")
    nodes, copies, raw, side = nodes[order], copies[order], raw[order], side[order]
    z = unit(raw) @ axes
    width = z.shape[1]
    steps = [s for s in STEPS if s < width] + [width]
    suffix = np.stack([np.sqrt((z[:, s:] ** 2).sum(1)) for s in steps], 1)
    n, cut = len(nodes), int(np.searchsorted(side, 1))
    counts, forest = np.zeros(n, np.int64), _Forest(n)

    def spans(lo, hi):
        return [slice(s, min(s + BLOCK, hi)) for s in range(lo, hi, BLOCK)]

    for a in spans(0, cut if two else n):
        for b in spans(cut, n) if two else [s for s in spans(0, n) if s.start >= a.start]:
            i, j = linked(z, raw, a, b, suffix, steps, threshold)
            if not two and a.start == b.start:
                i, j = i[i < j], j[i < j]
            if len(i):
                counts += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                forest.join_all(i, j)
    roots = np.array([forest.find(i) for i in range(n)], dtype=int)
    found = np.zeros(n, np.int64)
    found[order] = counts
    return found, [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(roots) if i != r]


def _cuts(values: DataFrame, column: str, parts: int) -> list[float]:
    """Inner cut points that split a column about evenly."""
    if parts < 2:
        return []
    q = values.approxQuantile(column, [k / parts for k in range(1, parts)], 0.25 / parts)
    return sorted(set(q))


def _reach(cuts: list[float], distance: float) -> list[list[int]]:
    """For each interval of a line cut at ``cuts``, those no further away than ``distance``."""
    low, high = [-math.inf, *cuts], [*cuts, math.inf]
    return [[j for j in range(len(low)) if low[j] - high[i] <= distance and low[i] - high[j] <= distance] for i in range(len(low))]


def _interval(column: str, cuts: list[float]):
    out = F.lit(0)
    for c in cuts:
        out = out + (F.col(column) >= c).cast("int")
    return out


def links(nodes: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """Rows (node, linked copies, other): counts have other null, forest edges a count of 0.

    ``tile``: vectors of a tile; ``tile_size`` of the table if not given.
    """
    spark = nodes.sparkSession
    sizes = nodes.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = spark.createDataFrame([], LINKS)
    # Vectors of different width have no cosine, so each width is a table of its own.
    for size in sizes:
        of = tile or tile_size(size["n"], size["width"])
        out = out.unionByName(_links_of_width(nodes.where(F.size("v") == size["width"]), size["width"], size["n"], threshold, of))
    return out


def _links_of_width(nodes, width, n, threshold, tile) -> DataFrame:
    axes = principal_axes(nodes, width)
    lead = axes[:, : min(2, width)]

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column(2))) @ lead if batch.num_rows else np.zeros((0, lead.shape[1]))
            cols = [*batch.columns, pa.array(x[:, 0]), pa.array(x[:, -1])]
            yield pa.RecordBatch.from_arrays(cols, ["node", "copies", "v", "c0", "c1"])

    placed = staged(
        nodes.select("node", "copies", "v").mapInArrow(coordinates, "node long, copies long, v array<double>, c0 double, c1 double"),
        "vectors",
    )
    distance = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    parts = math.ceil(math.sqrt(max(1, n / tile)))
    cuts = [_cuts(placed, "c0", parts), _cuts(placed, "c1", parts)]
    placed = placed.withColumns({"i": _interval("c0", cuts[0]), "j": _interval("c1", cuts[1])})
    # A cell with many vectors (near copies of one) is dealt into several tiles.
    cells = placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("cell"))
    cells = staged(cells.select("i", "j", F.ceil(F.col("cell") / tile).cast("int").alias("split")), "cells")
    tiles = placed.join(cells, ["i", "j"]).withColumn("s", F.pmod(F.xxhash64("node"), F.col("split").cast("long")).cast("int"))
    meets = tile_pairs(cells, [_reach(c, distance) for c in cuts])
    dealt = tiles.join(meets, ["i", "j", "s"]).select(*PAIR, "side", "node", "copies", "v")

    def run(pair: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw, two = _matrix(pdf["v"]), pair[:3] != pair[3:]
        node = pdf["node"].to_numpy()
        counts, edges = compare(node, pdf["copies"].to_numpy(float), raw, pdf["side"].to_numpy(), two, axes, threshold)
        return link_rows(node, counts, edges)

    return dealt.groupBy(*PAIR).applyInPandas(run, LINKS)


PAIR = ("i1", "j1", "s1", "i2", "j2", "s2")


def tile_pairs(cells: DataFrame, reach: list[list[list[int]]]) -> DataFrame:
    """Rows (i, j, s, side, *PAIR): each tile in each pair of tiles near enough to hold a link."""
    spark = cells.sparkSession
    near = [
        spark.createDataFrame([(p, q) for p, others in enumerate(r) for q in others], f"{k}1 int, {k}2 int")
        for k, r in zip("ij", reach)
    ]
    numbered = cells.select("i", "j", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("s"))
    one, two = (numbered.toDF(f"i{k}", f"j{k}", f"s{k}") for k in (1, 2))
    met = one.join(near[0], "i1").join(near[1], "j1").join(two, ["i2", "j2"])
    met = met.where(F.struct("i1", "j1", "s1") <= F.struct("i2", "j2", "s2"))
    first = met.select(F.col("i1").alias("i"), F.col("j1").alias("j"), F.col("s1").alias("s"), F.lit(0).alias("side"), *PAIR)
    other = met.where(F.struct("i1", "j1", "s1") != F.struct("i2", "j2", "s2"))
    return first.union(
        other.select(F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("s2").alias("s"), F.lit(1).alias("side"), *PAIR)
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    tile: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id, n_links, component_id and kept for every row.

    Null and zero vectors, those with null or non-finite components and rows
    with a null id link with nothing. Equal vectors are compared once and counted as often as they
    occur; vectors of different width do not link. Rows with the same id and
    vector count as copies of each other. Other columns are ignored; an empty
    table gives no rows.
    """
    nodes = staged(usable_vectors(vectors, id_col, vector_col), "vector-nodes")
    found = staged(links(nodes, threshold, tile), "vector-links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    member = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    smallest = member.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("members"))
    member = attach(staged(member, "vector-members"), staged(smallest, "vector-roots"), ["root"], "members")
    known = (
        nodes.join(member.select("node", "component"), "node", "left")
        .join(counts, "node", "left")
        .select(
            F.col("v").alias("key"),
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    plain, digest = F.col(vector_col).cast("array<double>"), lambda c: F.sha2(F.to_json(F.struct(c)), 256)
    v = F.transform(plain, lambda x: x + F.lit(0.0))
    # Rows that link with nothing, however many, have no key and meet nobody.
    key = F.when(F.col(id_col).isNotNull() & usable(plain), digest(v.alias("v")))
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("id"), key.alias("key")), "vector-rows")
    known = staged(known.withColumn("key", digest(F.col("key").alias("v"))), "vector-known")
    linked_rows = attach(rows.where("key IS NOT NULL"), known, ["key"], "copies")
    return linked_rows.select("id", "n_links", "component_id").unionByName(
        rows.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    ).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
