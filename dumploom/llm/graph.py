"""Groups, tiles and connected components: what the pair operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dumploom.llm.common import drop_path, materialize, scratch_path


#: Tasks over which the rows of one key are dealt where they are told what their group has in common.
SALTS = 32


class UnionFind:
    """Over 0 to n - 1, with path halving; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def told_apart(classes: DataFrame) -> DataFrame:
    """``classes`` (told apart by the hashes h1 and h2) with ``node``, one long for each: h1, or another hash where two classes have the same h1."""
    taken = classes.groupBy("h1").agg(F.count("*").alias("_n")).where("_n > 1").select("h1")
    if taken.isEmpty():  # nearly always: n classes meet with a chance of n^2 / 2^65
        return classes.withColumn("node", F.col("h1"))
    for salt in range(1, 100):
        numbered = classes.join(taken.withColumn("_taken", F.lit(True)), "h1", "left")
        numbered = numbered.withColumn("node", F.when(F.col("_taken"), F.xxhash64("h1", "h2", F.lit(salt))).otherwise(F.col("h1"))).drop("_taken")
        if numbered.groupBy("node").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
            return numbered
    raise RuntimeError("classes could not be told apart")


def of_group(rows: DataFrame, keys: list[str], by: str, name: str, part: Column, whole: Callable[[str], Column]) -> DataFrame:
    """``rows`` with ``name``: the aggregate ``part`` of the rows of their key, whose parts ``whole`` puts together.

    Rows of a key are dealt by ``by`` over ``SALTS`` tasks; one of these hands on its aggregate alone, and gets the whole back.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(31)), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(*keys, "_salt").agg(part.alias(name))
    wholes = parts.groupBy(*keys).agg(whole(name).alias(name), F.collect_set("_salt").alias("_salts"))
    return dealt.join(wholes.select(*keys, name, F.explode("_salts").alias("_salt")), [*keys, "_salt"]).drop("_salt")


def tiles(rows: DataFrame, keys: list[str], member: str, chunk: int, hot: bool = False) -> DataFrame:
    """``rows`` of keys that at least two members share, dealt into tiles of at most two chunks.

    A key's members are dealt by hash into chunks of about ``chunk``; a tile (tile_a, tile_b) gets two
    chunks, so that every pair of members meets in exactly one tile: within a chunk where tile_a =
    tile_b, else across. The column ``side`` is the row's own chunk. Keys of up to ``chunk`` members
    make one tile and no copies; sizes come from a pre-aggregated count. Rows of ``hot`` keys learn it in several tasks.
    """
    if hot:
        counted = of_group(rows, keys, member, "_n", F.count("*"), F.sum).where("_n > 1")
    else:
        counted = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), keys)
    sized = counted.withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("int"))
    sized = sized.withColumn("side", F.pmod(F.xxhash64(member, F.lit(77)), F.col("_chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")
    dealt = sized.select("*", other)
    return dealt.select(*rows.columns, "side", F.least("side", "_other").alias("tile_a"), F.greatest("side", "_other").alias("tile_b"))


def grouped(rows: DataFrame, keys: list[str], within: list[str] = []) -> DataFrame:
    """Rows of a key together and in order, for ``groups``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *within)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their bounds; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[-1] for k in keys):
            held.append(batch)  # still the same group
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        bounds = _bounds(table, keys)
        last = int(bounds[-2])
        if last:
            yield table.slice(0, last).combine_chunks(), bounds[:-1]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that the undirected ``edges`` (a, b; longs) reach, for nodes with edges.

    Alternating large-star and small-star steps; each round is a table in the shared folder. The edges
    of a node, however many, learn its least neighbour in several tasks.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, seen = None, None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = of_group(both, ["u"], "v", "m", F.min("v"), F.min)
        large = least.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = of_group(large, ["u"], "v", "m", F.min("v"), F.min).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch_path(spark, f"{name}-round")
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name, step)
        if path:
            drop_path(spark, path)
        path = step
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out._scratch = path
    return out
