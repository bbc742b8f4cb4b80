"""Sharding by sampled splitters.

Records are ordered by the hash of their text (equal texts stand together) and cut into many
small ranges at quantiles of a size-weighted key sample. Exact sizes of the ranges come from
one aggregation; a range that turns out overfull is cut again at its own sample's quantiles,
until none is. A group of equal texts too large for a range, by bytes or by rows, has ranges of
its own: one larger than a shard, or of too many rows, is subdivided by the hash of its ids and row numbers. Large items then go, largest first, to
the emptiest shard, and runs of ordinary ranges fill the shards up in key order, so that sizes
(the ``bytes`` law) come out near equal; equal texts share a shard unless their group itself
exceeds one.

What reaches the driver is one entry a range (rows / ``rows_per_range``, as little as a few MB
for billions of rows) and fewer large groups than shards / ``large_share`` and two a range.

Edge cases: null is a text of no bytes (size 16); null ids and rows equal in id and text are dealt by
row number; no rows: no shards; fewer rows than shards leave shards empty; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from dumploom.llm.common import arrow_map, materialize, schema_of

ROW_BYTES = 16


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    #: A group of equal texts with at least this share of a shard is placed on its own.
    large_share: float = 0.01
    ranges_per_shard: int = 64
    rows_per_range: int = 50_000
    samples_per_range: int = 8


def _records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (orders the texts) and spread (orders equal texts, rows of one id too). Rows get it once, as they are stored."""
    text = F.col("text").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw, F.lit(1)).alias("key"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("spread"),
    )


def _sampled(groups: DataFrame, step: float, params: ShardParams, salt: int) -> list[int]:
    """Keys in order, about ``samples_per_range`` for each range's worth of bytes or, if that is more, of rows."""
    chance = F.greatest(F.col("bytes") / F.lit(step), F.col("n") / F.lit(params.rows_per_range)) * params.samples_per_range
    draw = (F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return sorted(r.key for r in groups.where(draw < chance).select("key").collect())


def _range_of(rows: DataFrame, splitters: np.ndarray, keep: tuple[str, ...], pieces: dict[int, tuple[int, int]]) -> DataFrame:
    """``keep`` and the number of the range: below the first splitter 0; groups in ``pieces`` have their own, dealt by spread."""
    spark = rows.sparkSession
    large = np.array(sorted(pieces), np.int64)
    first, count = (np.array([pieces[k][i] for k in large.tolist()], np.int64) for i in (0, 1))
    shared = spark.sparkContext.broadcast((splitters, large, first, count))  # one entry a range
    kept = rows.select(*keep)

    def place(batches):
        cuts, large, first, count = shared.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            number = np.searchsorted(cuts, key, "right")
            if len(large):
                at = np.minimum(np.searchsorted(large, key), len(large) - 1)
                own = large[at] == key
                spread = (batch.column("spread").to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
                number = np.where(own, first[at] + (spread * count[at]).astype(np.int64), number)
            yield {c: batch.column(c) for c in keep} | {"part": number}

    return arrow_map(kept, place, schema_of(kept, keep, "part long"))


def _measure(rows: DataFrame) -> dict[int, tuple[int, int]]:
    got = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row a range
    return {r.part: (r.bytes, r.n) for r in got}


def assign(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """One row a record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = materialize(_records(docs), "shard-records")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    fair = max(total / params.shards, 1.0)
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    n_ranges = max(params.shards * params.ranges_per_shard, -(-n_rows // params.rows_per_range))
    step = max(total / n_ranges, 1.0)
    is_large = (F.col("bytes") >= min(params.large_share * fair, step)) | (F.col("n") > params.rows_per_range)
    large = {r.key: (r.bytes, r.n) for r in groups.where(is_large).collect()}
    small = groups.where(~is_large)
    sample = _sampled(small, step, params, 3)
    splitters = np.unique(np.array(sample[params.samples_per_range :: params.samples_per_range], np.int64))

    pieces, number = {}, 1 << 40  # ranges of large groups are numbered apart
    for key, (size, n) in sorted(large.items()):
        n_pieces = max(1 if size <= fair else int(np.ceil(size / fair * params.ranges_per_shard)), -(-n // params.rows_per_range))
        pieces[key] = (number, n_pieces)
        number += n_pieces
    for salt in itertools.count(4):  # a small group is at most a range, so that an overfull range holds several and each round cuts one at least
        sizes = _measure(_range_of(rows, splitters, ("key", "spread", "size"), pieces))
        over = sorted(p for p, (size, n) in sizes.items() if p < 1 << 40 and (size > 3 * step or n > 3 * params.rows_per_range))
        if not over:
            break
        wide = spark.createDataFrame([(p,) for p in over], "part long")
        inside = _range_of(small.withColumn("spread", F.lit(0).cast("long")), splitters, ("key", "bytes", "n", "spread"), {}).join(wide, "part", "left_semi")
        more = _sampled(inside, step, params, salt)[params.samples_per_range // 2 :: params.samples_per_range]
        merged = np.union1d(splitters, np.array(more, np.int64))
        if len(merged) == len(splitters):  # the draw had too few
            last = [r.key for r in inside.groupBy("part").agg(F.max("key").alias("key")).collect()]  # at most one a range
            merged = np.union1d(splitters, np.array(last, np.int64))
        if len(merged) == len(splitters):
            break
        splitters = merged

    home, offset = _pack(sizes, pieces, large, fair, params.shards)
    known = sorted(home)
    table = spark.createDataFrame([(p, home[p], offset[p]) for p in known], "part long, shard int, first long")
    ranked = Window.partitionBy("part").orderBy("key", "spread", "doc_id", "size")
    placed = _range_of(rows, splitters, ("doc_id", "size", "text_crc32", "key", "spread"), pieces)
    slots = placed.withColumn("_rank", F.row_number().over(ranked)).join(table, "part")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _pack(sizes: dict, pieces: dict, large: dict, fair: float, shards: int) -> tuple[dict[int, int], dict[int, int]]:
    """The shard of each range, and the rows of its shard before it.

    A large group that fits a shard goes there whole, a larger one by its pieces; then ordinary
    ranges fill the shards in key order, each cut being put where it misses the mark least.
    """
    bins = [(0, s) for s in range(shards)]
    home: dict[int, int] = {}
    items = []
    for key, (first, n) in pieces.items():
        parts = [p for p in range(first, first + n) if p in sizes]
        if large[key][0] <= fair:
            items.append((sum(sizes[p][0] for p in parts), parts))
        else:
            items += [(sizes[p][0], [p]) for p in parts]
    for size, parts in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(bins)
        home.update(dict.fromkeys(parts, s))
        heapq.heappush(bins, (load + size, s))
    load = dict((s, x) for x, s in bins)
    ordinary = sorted(p for p in sizes if p not in home)
    rest, s = sum(sizes[p][0] for p in ordinary), 0
    level = _level(sorted(load.values()), rest)
    for p in ordinary:
        while s < shards - 1 and load[s] + sizes[p][0] / 2 > level:
            s += 1
        home[p] = s
        load[s] += sizes[p][0]
        rest -= sizes[p][0]
    _even_out(home, load, {p: sizes[p][0] for p in ordinary})
    offset, filled = {}, [0] * shards
    for p in sorted(home):
        offset[p] = filled[home[p]]
        filled[home[p]] += sizes[p][1]
    return home, offset


def _level(loads: list[int], rest: int) -> float:
    """The height to which ``rest`` fills the least loaded."""
    for k, at in enumerate([*loads[1:], float("inf")], 1):
        if at * k - sum(loads[:k]) >= rest:
            return (sum(loads[:k]) + rest) / k
    return 0.0


def _even_out(home: dict[int, int], load: dict[int, int], size: dict[int, int]) -> None:
    """Move single ranges from the fullest to the emptiest shard while that narrows their gap."""
    held: dict[int, list[int]] = {}
    for p in size:
        held.setdefault(home[p], []).append(p)
    for _ in range(8 * len(load)):
        top, low = max(load, key=load.get), min(load, key=load.get)
        gap = load[top] - load[low]
        fit = [p for p in held.get(top, []) if 0 < size[p] < gap]
        if not fit:
            return
        best = min(fit, key=lambda p: (abs(size[p] - gap / 2), p))
        held[top].remove(best)
        held.setdefault(low, []).append(best)
        home[best] = low
        load[top] -= size[best]
        load[low] += size[best]


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
