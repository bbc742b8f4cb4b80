"""Near-duplicate texts: an n-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of five-word shingles. Texts of equal sets (by two 64-bit hashes of the whole set) form one class. Classes with an
equal band of MinHash values are candidates; their MinHash values are compared a few at a time
and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold (uniform prior, binomial matches) falls below a tolerance. Surviving pairs only
connect classes into neighbourhoods; inside a neighbourhood every pair is compared again and
those that survive pruning are verified on their whole shingle sets.

No pairs are ever rows: large groups are cut into tiles, a tile returns a link count for each
class and a spanning forest of its links.

Edge cases: a text without words (null included) has no shingles and no links; one of fewer than five
words is one shingle; null ids take part, a group's class_id is its smallest id that is not null; rows equal in
text are links to each other; all shingles of a text count, whatever its length; no rows: none; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import WORD_TABLE, RangeHash, arrow_map, carried, forget, materialize, mix64, schema_of, text_bytes, unpacked, utf8
from dumploom.llm.graph import UnionFind, components, grouped, groups, of_group, tiles, told_apart


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold: float = 0.8
    #: In bands of four values: of pairs at the threshold (1 - t^4)^32, 5 in 10^8, share no band.
    hashes: int = 128
    #: MinHash values compared at a time, and the posterior below which a pair is dropped.
    step: int = 32
    tolerance: float = 1e-7
    chunk: int = 1500


_BLOCK = 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """A 62-bit hash of each word, in order."""
    found, held = [], []
    for at in range(0, len(text), _BLOCK):
        block = text[at : at + _BLOCK].translate(WORD_TABLE)
        cut = block.rfind(b" ") + 1 if at + _BLOCK < len(text) else len(block)
        held.append(block[:cut] if cut else block)
        if not cut:
            continue  # all of one word, which goes on
        raw = np.frombuffer(b" " + b"".join(held) + b" ", np.uint8)
        held = [block[cut:]]
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        found.append(RangeHash(raw[1:]).ranges(edge[0::2], edge[1::2]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted, distinct hashes of runs of ``n`` words; of all words where there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(h)]
    return np.unique(mix64(h + np.uint64(size)))


@lru_cache(2)
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(s: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of 16 bits."""
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            low = np.minimum(low, np.multiply.outer(s[at : at + 2048], _multipliers(n)).min(axis=0))
        return (mix64(low + np.arange(n, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def least_matches(params: JoinParams) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): below, P(similarity >= t | matches) < tolerance.

    With a uniform prior that posterior is P(Binomial(n + 1, t) <= matches).
    """
    out, t = [], params.threshold
    for n in range(params.step, params.hashes + 1, params.step):
        below, m = 0.0, -1
        while below < params.tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(row: np.ndarray, others: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Indexes of the rows of ``others`` (MinHash values) that pruning leaves for ``row``."""
    at, matches, done = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, least in needed:
        matches = matches + (others[at, done:n] == row[done:n]).sum(axis=1)
        fit = matches >= least
        at, matches, done = at[fit], matches[fit], n
        if not len(at):
            break
    return at


def sketch(docs: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, text_key, n_shingles, h1 and h2 (of the shingle set), sig; one row a document."""
    rows = docs.select("doc_id", text_bytes("text").alias("text"), F.xxhash64(text_bytes("text")).alias("text_key"))

    def run(batches):
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for text in utf8(batch.column("text")):
                s = shingles(text, params.words)
                a, b = set_hash(s)
                n.append(len(s))
                h1.append(a)
                h2.append(b)
                sig.append(minhash(s, params.hashes).tobytes() if len(s) else b"")
            yield {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_shingles": n, "h1": h1, "h2": h2, "sig": sig}

    return arrow_map(rows, run, schema_of(rows, ["doc_id"], "text_key long, n_shingles long, h1 long, h2 long, sig binary"))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = np.ascontiguousarray(sig).view(np.int64)  # a band is its four 16-bit values
            n = keys.shape[1]
            yield {"band": np.tile(np.arange(n, dtype=np.int32), len(keys)), "key": keys.ravel(), "node": np.repeat(batch.column("node").to_numpy(), n)}

    return arrow_map(classes.select("node", "sig"), run, "band int, key long, node long")


def _connect(table, bounds, needed):
    """Spanning edges of the pairs that survive pruning, tile by tile.

    Members already connected need no comparison: each round compares one member with all others.
    """
    nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    across = (table.column("tile_a").to_numpy() != table.column("tile_b").to_numpy())
    sigs = table.column("sig").to_pylist()
    a, b = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sig = np.frombuffer(b"".join(sigs[lo:hi]), np.uint16).reshape(hi - lo, -1)
        found = UnionFind(hi - lo)
        roots = np.arange(hi - lo)
        for x in range(hi - lo):
            other = roots != roots[x]
            if across[lo]:
                other &= side[lo:hi] != side[lo + x]
            at = np.flatnonzero(other)
            near = at[survivors(sig[x], sig[at], needed)] if len(at) else at
            for y in near.tolist():
                if found.join(x, y):
                    a.append(nodes[lo + x])
                    b.append(nodes[lo + y])
            if len(near):
                roots = found.roots()
    return {"a": a, "b": b}


def _verify(table, bounds, params: JoinParams, needed):
    """Exact links inside each tile: for each class the copies of its partners, and a spanning forest."""
    nodes, side, mult = (table.column(c).to_numpy() for c in ("node", "side", "mult"))
    across = (table.column("tile_a").to_numpy() != table.column("tile_b").to_numpy())
    sets = table.column("shingles").to_pylist()
    node, other, links = [], [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        pick = lo + np.unique(nodes[lo:hi], return_index=True)[1]  # a class may have come more than once
        s = [np.frombuffer(sets[i], np.uint64) for i in pick]
        n = np.array([len(x) for x in s], np.float64)
        linked = exact_links(s, n, params, needed)
        if across[lo]:
            linked &= side[pick][:, None] != side[pick][None, :]
        count = (linked * mult[pick][None, :]).sum(axis=1)
        found = UnionFind(len(pick))
        for x in np.flatnonzero(count):
            node.append(nodes[pick[x]])
            other.append(None)
            links.append(int(count[x]))
            for y in np.flatnonzero(linked[x, :x]).tolist():
                if found.join(int(x), y):
                    node.append(nodes[pick[x]])
                    other.append(nodes[pick[y]])
                    links.append(0)
    return {"node": node, "other": other, "links": links}


def exact_links(sets: list[np.ndarray], n: np.ndarray, params: JoinParams, needed) -> np.ndarray:
    """Pairs of ``sets`` that survive pruning and whose Jaccard similarity reaches the threshold."""
    m = len(sets)
    sig = np.array([minhash(x, params.hashes) for x in sets])
    alive = np.zeros((m, m), bool)
    for x in range(m - 1):
        near = survivors(sig[x], sig[x + 1 :], needed) + x + 1
        alive[x, near] = alive[near, x] = True
    if not alive.any():
        return alive
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), n.astype(np.int64))
    shared = np.bincount(column, minlength=len(values)) > 1
    order = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], order[column[keep]]
    both = np.zeros((m, m), np.float64)
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((m, width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    union = n[:, None] + n[None, :] - both
    return alive & (both >= params.threshold * union - 1e-9)


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id its links reach), n_links (texts linked directly, copies included),
    kept (doc_id = class_id) and the text_key and group that tell rows apart; one row a document."""
    needed = least_matches(params)
    rows = materialize(sketch(docs, params), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(
        F.count("*").alias("mult"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("sig").alias("sig")
    )
    kept_classes = materialize(classes, "classes")
    classes = told_apart(kept_classes)
    bucket = ["band", "key", "tile_a", "tile_b"]
    near = tiles(_bands(classes), ["band", "key"], "node", params.chunk)
    near = near.join(classes.select("node", "sig"), "node")
    edges = arrow_map(grouped(near, bucket), lambda b: (_connect(t, k, needed) for t, k in groups(b, bucket)), "a long, b long")
    near_edges = materialize(edges.distinct(), "near-edges")
    hoods = components(near_edges, "hoods")

    inside = classes.join(hoods, "node").select("node", "component", "mult", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key"))
    texts = docs.select(F.col("doc_id").alias("_doc"), text_bytes("text").alias("text")).withColumn("_text_key", F.xxhash64("text"))
    fetched = texts.join(inside, (F.col("_text_key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")))

    def reshingle(batches):
        for batch in batches:
            s = [shingles(t, params.words).tobytes() for t in utf8(batch.column("text"))]
            yield {c: batch.column(c) for c in ("node", "component", "mult")} | {"shingles": s}

    sets = arrow_map(fetched.select("node", "component", "mult", "text"), reshingle, "node long, component long, mult long, shingles binary")
    tile = ["component", "tile_a", "tile_b"]
    sets = materialize(sets, "sets")
    dealt = tiles(sets, ["component"], "node", params.chunk, hot=True)
    found = arrow_map(
        grouped(dealt, tile), lambda b: (_verify(t, k, params, needed) for t, k in groups(b, tile)), "node long, other long, links long"
    )
    found = materialize(found, "links")
    forget(near_edges, hoods, sets)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "links")

    of_class = classes.select("node", "h1", "h2", "mult", F.col("rep.doc_id").alias("first")).join(links, "node", "left").join(final, "node", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "node"))
    known = of_group(of_class, ["component"], "node", "class_id", F.min("first"), F.min).select(
        "h1", "h2", F.col("component").alias("group"), "class_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    joined = rows.join(known, ["h1", "h2"], "left")
    class_id = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return joined.select(
        "doc_id", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("doc_id").eqNullSafe(class_id).alias("kept"), "text_key", "group",
    )


def drop_near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of its smallest id (of texts with that id, one); same columns."""
    kept = near_duplicates(docs, params).where("kept")
    one = kept.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("_id"), F.min("text_key").alias("_key"))
    alone = kept.where("group is null").select("group", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    keys = one.union(alone.distinct())
    rows = docs.select(carried(docs), F.col("doc_id").alias("_doc"), F.xxhash64(text_bytes("text")).alias("_text_key"))
    met = rows.join(keys, (F.col("_text_key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")))
    single = met.where("group is not null").dropDuplicates(["_text_key", "_doc"])
    return single.unionByName(met.where("group is null")).select(*unpacked(docs.schema))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "kept")
