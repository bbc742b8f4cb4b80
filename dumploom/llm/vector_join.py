"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine >= t differ by a squared distance of at most 2 - 2t. Vectors are
rotated (a fixed random rotation spreads the distance evenly) and cut into blocks of
coordinates; each block gets its proportional part of that budget, and a pair within the whole
budget is within its part in some block. Each block is range-joined on a grid over its first
coordinates, whose cells are twice the block's radius wide: a vector is in its own cell and
probes later cells within the radius. Candidates of a cell are verified by their cosine in
double precision, each pair in its first fitting block only. Blocks of 16 coordinates leave next
to no false candidates, and few blocks mean few copies; cells and tiles are dealt by ids alone, so
that vectors are moved once, to the tiles they are compared in.

Pairs are never rows: a tile (see ``graph.tiles``) returns link counts and a spanning forest.

Edge cases: a vector that is null, empty or zero, or that holds null or non-finite components, links with
nothing; vectors of different lengths do not link; equal vectors are one class with a count, so
a very common vector costs as much as one; null ids take part, a component's id is its smallest that
is not null; no rows: none; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import arrow_map, materialize
from dumploom.llm.graph import UnionFind, components, grouped, groups, tiles, told_apart


@dataclass(frozen=True)
class VectorParams:
    threshold: float = 0.95
    block: int = 16  # coordinates in a block
    grid: int = 2  # of which so many make the grid
    chunk: int = 12_000


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]


def blocks(d: int, params: VectorParams) -> list[tuple[int, int, float]]:
    """(first, end, budget) of each block; budgets are proportional to the blocks' widths."""
    whole = (2 - 2 * params.threshold) * (1 + 1e-9)
    return [(a, min(a + params.block, d), whole * (min(a + params.block, d) - a) / d) for a in range(0, d, params.block)]


def rotated(raw: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated."""
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ rotation(raw.shape[1])


def _distances(x: np.ndarray, parts) -> np.ndarray:
    """Squared length of each block of each difference in ``x``."""
    return np.stack([(x[:, a:b] ** 2).sum(axis=1) for a, b, _ in parts], axis=1)


def _cells(raw: np.ndarray, params: VectorParams):
    """(block, cell hash, row, whether at home) for every home cell and every later cell within reach."""
    y = rotated(raw)
    for k, (a, b, budget) in enumerate(blocks(raw.shape[1], params)):
        radius = np.sqrt(budget) * (1 + 1e-6)
        x = y[:, a : min(a + params.grid, b)] / (2 * radius)
        home = np.floor(x).astype(np.int64)
        low, high = x - home <= 0.5, home + 1 - x <= 0.5
        shifts = np.stack(np.meshgrid(*[(-1, 0, 1)] * x.shape[1], indexing="ij"), -1).reshape(-1, x.shape[1])
        for shift in shifts:
            if tuple(shift) < (0,) * x.shape[1]:
                continue  # an earlier cell probes us
            reach = np.ones(len(x), bool)
            for j, s in enumerate(shift):
                reach &= low[:, j] if s < 0 else high[:, j] if s > 0 else True
            at = np.flatnonzero(reach)
            cell = home[at] + shift
            key = np.full(len(at), k + 1000 * raw.shape[1], np.int64)
            for j in range(x.shape[1]):
                key = key * 20011 + cell[:, j] + 10000
            yield np.full(len(at), k, np.int32), key, at, np.full(len(at), not shift.any())


def _sides(home: np.ndarray, side: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, rows, whether to pair each only with later ones) which cover each pair that has a row at home once; with ``side``, of different sides."""
    if side is None:
        order = np.argsort(~home, kind="stable")
        return [(order[: home.sum()], order, True)]
    first = side == side[0]
    return [(np.flatnonzero(first & home), np.flatnonzero(~first), False), (np.flatnonzero(first & ~home), np.flatnonzero(~first & home), False)]


def _close(part: np.ndarray, budget: float, sides: list, high: int = 256, wide: int = 2048):
    """Pairs of rows of ``part`` whose squared distance may be within ``budget``, in pieces that fit the processor's cache."""
    for rows, columns, later in sides:
        x, y = part[rows], part[columns]
        x_square, y_square = ((z**2).sum(axis=1) for z in (x, y))
        y = np.ascontiguousarray(2 * y.T)
        for at in range(0, len(x), high):
            bound = (x_square[at : at + high] - np.float32(budget + 1e-5))[:, None]
            for to in range(at if later else 0, len(columns), wide):
                near = x[at : at + high] @ y[:, to : to + wide]
                near -= y_square[to : to + wide]
                found = np.flatnonzero(near >= bound)
                if len(found):
                    i, j = np.divmod(found, near.shape[1])
                    i, j = i + at, j + to
                    if later:
                        i, j = i[i < j], j[i < j]
                    yield rows[i], columns[j]


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All components of a column of arrays, and where each row's begin (and the last one's end)."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(rows).to_numpy()))


def _verify(table, bounds, params: VectorParams):
    nodes, side, mult, home, block = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "mult", "home", "block"))
    across = table.column("tile_a").to_numpy() != table.column("tile_b").to_numpy()
    values, ends = _flat(table.column("v"))
    out_node, out_other, out_links = [], [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if not home[lo:hi].any():
            continue
        raw = values[ends[lo] : ends[hi]].reshape(hi - lo, -1).astype(np.float64)
        y, k = rotated(raw), block[lo]
        parts = blocks(raw.shape[1], params)
        a, b, budget = parts[k]
        part = y[:, a:b].astype(np.float32)
        found = UnionFind(hi - lo)
        count = np.zeros(hi - lo, np.int64)
        unit = np.linalg.norm(raw, axis=1)
        for i, j in _close(part, budget, _sides(home[lo:hi], side[lo:hi] if across[lo] else None)):
            for s in range(0, len(i), 100_000):
                p, q = i[s : s + 100_000], j[s : s + 100_000]
                d = _distances(y[p] - y[q], parts)
                first = (d <= np.array([x[2] for x in parts])).argmax(axis=1)
                good = (first == k) & (d[:, k] <= budget)
                good &= (raw[p] * raw[q]).sum(axis=1) / (unit[p] * unit[q]) >= params.threshold
                p, q = p[good], q[good]
                np.add.at(count, p, mult[lo + q])
                np.add.at(count, q, mult[lo + p])
                if len(p) > hi - lo:  # most pairs of a large group are connected already
                    root = found.roots()
                    apart = root[p] != root[q]
                    p, q = p[apart], q[apart]
                for x, z in zip(p.tolist(), q.tolist(), strict=True):
                    if found.join(x, z):
                        out_node.append(nodes[lo + x])
                        out_other.append(nodes[lo + z])
                        out_links.append(0)
        for x in np.flatnonzero(count):
            out_node.append(nodes[lo + x])
            out_other.append(None)
            out_links.append(int(count[x]))
    return {"node": out_node, "other": out_other, "links": out_links}


def near_vectors(vectors: DataFrame, params: VectorParams = VectorParams()) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id its links reach) and kept, one row a vector."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    values = F.col("embedding").cast(f"array<{kind}>")
    good = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select("vec_id", values.alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("good"), F.expr(f"transform(v, x -> x + cast(0 as {kind}))")))
    rows = rows.withColumns({"h1": F.when(F.col("good"), F.xxhash64("v")), "h2": F.when(F.col("good"), F.xxhash64(F.lit(5), "v"))}).drop("good")
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    classes = told_apart(materialize(classes, "vector-classes"))

    def cells(batches):
        for batch in batches:
            values, ends = _flat(batch.column("v"))
            sizes, node = np.diff(ends), batch.column("node").to_numpy()
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                raw = values[ends[pick][:, None] + np.arange(d)].astype(np.float64)
                for block, key, at, home in _cells(raw, params):
                    yield {"block": block, "key": key, "home": home, "node": node[pick[at]]}

    dealt = tiles(arrow_map(classes.select("node", "v"), cells, "block int, key long, home boolean, node long"), ["block", "key"], "node", params.chunk)
    dealt = dealt.join(classes.select("node", "mult", "v"), "node")
    tile = ["block", "key", "tile_a", "tile_b"]
    found = arrow_map(grouped(dealt, tile), lambda b: (_verify(t, k, params) for t, k in groups(b, tile)), "node long, other long, links long")
    found = materialize(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors")
    known = classes.drop("v").join(links, "node", "left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "component").select("h1", "h2", "component_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component, F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
