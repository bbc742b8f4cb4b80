"""Removal of repeated byte strings, by threshold-bounded expansion of Burrows-Wheeler intervals.

Every ``length``-byte window of a text chooses an anchor: the ``gram`` in it of the least hash, the first
of equals. Equal windows choose equal anchors at equal offsets, so grouping anchors by their
content brings every pair of equal windows together, wherever they are. An anchor serves a run
of windows; the bytes under that run are its context. Then, for anchors that occur again:

* occurrences with equal contexts repeat as a whole; a context is kept once, with its count;
* the distinct contexts of a group are joined by separators, their Burrows-Wheeler transform is
  taken and intervals are extended backwards, breadth first: step n sets the common-prefix values of
  n, each once, and the walk stops at ``length``; neighbours without a value share a window;
* groups too large for one task are refined first: runs are cut in eight and regrouped by the
  bytes that all windows of a part share. A part of one window is its own content, so this ends.

The result covers every window of every text, same-text repeats included; no group, however common
its passage, is gathered in one task.

Edge cases: null is the empty text; texts shorter than a window keep all; very long texts are read
in blocks; rows equal in id and text are repeats of each other; null ids take part; no rows: none;
other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import RangeHash, arrow_map, carried, forget, materialize, mix64, schema_of, text_bytes, utf8, with_cut_texts
from dumploom.llm.graph import grouped, groups


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400
    gram: int = 64
    #: Distinct contexts of an anchor that one task takes; more are refined.
    most_contexts: int = 800
    #: Bytes of contexts in one transform (a larger group of at most ``most_contexts`` still is one); some 100 bytes of memory for each.
    transform_bytes: int = 1 << 19
    split: int = 8
    block: int = 1 << 17  # windows of a text handled at once; positions in a block must fit 20 bits


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A cheap hash of every run of ``size`` bytes, by doubling. It only picks anchors: equal runs must agree, and unequal ones may."""
    h, width, base = raw.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    whole, done = None, 0  # of the first ``done`` bytes of each run
    with np.errstate(over="ignore"):
        while True:
            up = np.uint64(pow(base, width, 1 << 64))
            if size & width:
                whole = h if whole is None else whole[: len(h) - done] * up + h[done:]
                done += width
            if done == size:
                return mix64(whole[: len(raw) - size + 1])
            h = h[:-width] * up + h[width:]
            width *= 2


def anchors(raw: np.ndarray, p: RepeatParams):
    """(first window, last window, anchor hash, context hash, anchor's distance from the first window) arrays of a block's anchors."""
    n = len(raw) - p.length + 1
    gram = gram_hashes(raw, p.gram)
    low = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
    width, size = p.length - p.gram + 1, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], n) - 1
    return first, last, gram[at[first]], RangeHash(raw).ranges(first, last + p.length), at[first] - first


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as disjoint ranges."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def _occurrences(p: RepeatParams):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("k1", "k2", "anchor", "context", "lo", "hi", "n", "far")}

            def add(k1, k2, *rest, out=out):
                for name, v in zip(out, (np.full(len(rest[0]), k1), np.full(len(rest[0]), k2), *rest), strict=True):
                    out[name].append(v)

            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), utf8(batch.column("text")), strict=True):
                whole = np.frombuffer(text, np.uint8)
                for at in range(0, len(whole) - p.length + 1, p.block):
                    lo, hi, anchor, context, far = anchors(whole[at : at + p.block + p.length - 1], p)
                    _, index, back, count = np.unique(np.stack([anchor, context], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                    add(k1, k2, anchor[index].view(np.int64), context[index].view(np.int64), lo[index] + at, hi[index] + at, count, far[index])
                    if (again := count[back.ravel()] > 1).any():  # repeats inside the block: found here
                        a, b = _merge(lo[again] + at, hi[again] + at + p.length)
                        none = np.zeros(len(a), np.int64)
                        add(k1, k2, none, none, a, b, none, none)
            yield {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return run


def suffix_array(symbols: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order; a separator (0) ends a suffix, ties then go by ``owner``. ``left``: symbols before the separator."""
    n, k = len(symbols), 7
    padded = np.append(symbols, np.zeros(k, symbols.dtype))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= 9
        key |= np.where(left >= j, padded[j : j + n], 0)
    rank = np.zeros(n, np.int32)  # where a suffix's ties begin in the order
    open_, k = np.arange(n, dtype=np.int32), 7
    open_ = _settle(rank, open_, key)
    del key, padded
    while len(open_):
        ahead = rank[np.minimum(open_ + k, n - 1)]
        ended = left[open_] < k
        ahead[ended] = owner[open_[ended]]
        open_ = _settle(rank, open_, rank[open_].astype(np.int64) * (n + 1) + ahead)
        k *= 2
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def _settle(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order the suffixes ``open_`` by ``key`` within their ties, set their ranks and return those that still tie."""
    by = np.argsort(key)
    at, key, before = open_[by], key[by], rank[open_[by]]
    new, old = (np.flatnonzero(np.append(True, x[1:] != x[:-1])) for x in (key, before))
    sizes = np.diff(np.append(new, len(at)))
    start_of_old = np.repeat(old, np.diff(np.append(old, len(at))))
    rank[at] = before + np.repeat(new, sizes) - start_of_old
    return at[np.repeat(sizes > 1, sizes)]


def shared_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the offsets of its windows that another window in ``bodies`` equals."""
    sizes = np.array([len(b) + 1 for b in bodies])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbols = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends - 1] = 0
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
    left = (np.repeat(ends, sizes) - 1 - np.arange(n)).astype(np.int32)
    order = suffix_array(symbols, owner, left)
    del owner, left
    bwt = symbols[order - 1]  # of the suffix at 0 this is the last separator
    back = np.empty(n, np.int32)  # where a suffix's extension by its preceding symbol stands
    back[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)

    front = symbols[order]
    common = np.full(n + 1, -1, np.int16)
    common[:n][np.append(True, (front[1:] != front[:-1]) | (front[1:] == 0))] = 0
    common[n] = 0
    edge = np.flatnonzero(common[:n] == 0)
    lb, rb = edge, np.append(edge[1:], n) - 1
    for value in range(1, length):
        if not len(lb):
            break
        one = lb == rb
        r = lb[one]
        r = back[r[bwt[r] != 0]]
        fresh = r[common[r + 1] < 0]
        common[fresh + 1] = value
        new_lb, new_rb = [fresh], [fresh]
        a, b = lb[~one], rb[~one]
        if len(a):
            width = b - a + 1
            of = np.repeat(np.arange(len(a), dtype=np.int32), width)
            rows = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(width) - width - a).astype(np.int32), width)
            kept = bwt[rows] != 0
            of, rows = of[kept], rows[kept]
            if len(rows):
                sort = np.argsort(of.astype(np.int64) * (n + 1) + back[rows])
                of, rows = of[sort], rows[sort]
                to, symbol = back[rows], bwt[rows]
                start = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])))
                low, high = to[start], to[np.append(start[1:], len(to)) - 1]
                fresh = common[high + 1] < 0
                common[high[fresh] + 1] = value
                new_lb.append(low[fresh])
                new_rb.append(high[fresh])
        lb, rb = np.concatenate(new_lb), np.concatenate(new_rb)
    shared = (common[:n] < 0) | (common[1:] < 0)
    position = np.sort(order[shared])
    cut = np.searchsorted(position, ends)
    first = ends - sizes
    return [position[(cut[i - 1] if i else 0) : cut[i]] - first[i] for i in range(len(bodies))]


def _transform(p: RepeatParams):
    def run(batches):
        for table, bounds in groups(batches, ["anchor"]):
            k1, k2, lo, n = (table.column(c).to_numpy() for c in ("k1", "k2", "lo", "n"))
            bodies = table.column("body").to_pylist()
            out = {k: [] for k in ("k1", "k2", "start", "end")}
            first, size = 0, 0
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size += sum(map(len, bodies[a:b]))
                if size < p.transform_bytes and b < table.num_rows:
                    continue
                for i, windows in enumerate(shared_windows(bodies[first:b], p.length), first):
                    if n[i] == 1 and len(windows):
                        s, e = _merge(lo[i] + windows, lo[i] + windows + p.length)
                        out["k1"] += [k1[i]] * len(s)
                        out["k2"] += [k2[i]] * len(s)
                        out["start"] += s.tolist()
                        out["end"] += e.tolist()
                first, size = b, 0
            yield out

    return run


RANGES = "k1 long, k2 long, start long, end long"
CONTEXT = "anchor long, context long, k1 long, k2 long, lo long, hi long, n long, far long, body binary"


def _refine(p: RepeatParams, step: int):
    """Cut runs of windows by their distance from the anchor, ``step`` distances to a part; a part's anchor is what all windows at these distances share."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("anchor", "context", "k1", "k2", "lo", "hi", "n", "far", "body")}
            for row in batch.to_pylist():
                h, far, runs = RangeHash(np.frombuffer(row["body"], np.uint8)), row["far"], row["hi"] - row["lo"] + 1
                cells = np.arange((far - runs + 1) // step, far // step + 1)
                nearest, farthest = far - cells * step, far - (cells * step + step - 1)  # windows at the cells' ends
                a, b = np.maximum(farthest, 0), np.minimum(nearest, runs - 1)
                core, whole = h.ranges(nearest, farthest + p.length), h.ranges(a, b + p.length)
                with np.errstate(over="ignore"):
                    core = mix64(core + np.uint64(row["anchor"] & (1 << 64) - 1) + cells.astype(np.uint64))
                out["anchor"] += core.view(np.int64).tolist()
                out["context"] += whole.view(np.int64).tolist()
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    values = (row["k1"], row["k2"], row["lo"] + i, row["lo"] + j, row["n"], far - i, row["body"][i : j + p.length])
                    for name, v in zip(("k1", "k2", "lo", "hi", "n", "far", "body"), values, strict=True):
                        out[name].append(v)
            yield out

    return run


def _group(rows: DataFrame) -> DataFrame:
    """``rows`` of anchors that occur again, with ``total`` (of the context) and ``contexts``, ``singles`` (of the anchor)."""
    of_context = rows.groupBy("anchor", "context").agg(F.sum("n").alias("total"))
    of_anchor = of_context.groupBy("anchor").agg(
        F.count("*").alias("contexts"), F.sum("total").alias("uses"), F.count(F.when(F.col("total") == 1, 1)).alias("singles")
    )
    of_anchor = of_anchor.where("uses > 1").drop("uses")
    return rows.join(of_context.join(of_anchor, "anchor"), ["anchor", "context"])


def _whole(rows: DataFrame, p: RepeatParams) -> DataFrame:
    return rows.where("total > 1").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + p.length).alias("end"))


def repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """Ranges of repeated bytes of ``docs`` (k1, k2, text as bytes), which may overlap: k1, k2, start, end."""
    found = materialize(arrow_map(docs, _occurrences(p), "k1 long, k2 long, anchor long, context long, lo long, hi long, n long, far long"), "anchors")
    inside = found.where("n = 0").select("k1", "k2", F.col("lo").alias("start"), F.col("hi").alias("end"))
    again = materialize(_group(found.where("n > 0")), "repeated-anchors")
    ranges = [inside, _whole(again, p)]

    unsure = again.where("contexts > 1 and singles > 0")
    picked = unsure.groupBy("anchor", "context").agg(
        F.min(F.struct("k1", "k2", "lo", "hi", "far")).alias("r"), F.first("total").alias("n"), F.first("contexts").alias("contexts")
    )
    wanted = picked.groupBy("r.k1", "r.k2").agg(F.collect_list(F.struct("anchor", "context", "r.lo", "r.hi", "r.far", "n", "contexts")).alias("spots"))
    fetched = docs.join(wanted, ["k1", "k2"])

    def bodies(batches):
        names = ("anchor", "context", "lo", "hi", "far", "n", "contexts")
        for batch in batches:
            out = {k: [] for k in ("k1", "k2", "body", *names)}
            for k1, k2, text, spots in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), utf8(batch.column("text")), batch.column("spots").to_pylist(), strict=True):
                for s in spots:
                    out["k1"].append(k1)
                    out["k2"].append(k2)
                    out["body"].append(text[s["lo"] : s["hi"] + p.length])
                    for name in names:
                        out[name].append(s[name])
            yield out

    now = materialize(arrow_map(fetched, bodies, f"{CONTEXT}, contexts long"), "contexts")
    used = [found, again, now]
    step = p.length - p.gram + 1
    while True:
        small = now.where(F.col("contexts") <= p.most_contexts)
        ranges.append(arrow_map(grouped(small, ["anchor"]), _transform(p), RANGES))
        large = now.where(F.col("contexts") > p.most_contexts)
        if large.isEmpty():
            break
        step = -(-step // p.split)
        cut = materialize(arrow_map(large.drop("contexts"), _refine(p, step), CONTEXT), "parts")
        parts = _group(cut)
        ranges.append(_whole(parts.where("n = 1"), p))
        unsure = parts.where("contexts > 1 and singles > 0").drop("n", "singles").withColumnRenamed("total", "n")
        now = materialize(unsure.dropDuplicates(["anchor", "context"]), "contexts")
        used += [cut, now]
    every = ranges[0]
    for more in ranges[1:]:
        every = every.unionByName(more)
    every = materialize(every, "ranges")
    forget(*used)
    return every


def _keyed(docs: DataFrame, columns: list) -> DataFrame:
    text = text_bytes("text")
    return docs.select(*columns, F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(5), "doc_id").alias("k2"), text.alias("text"))


def _with_ranges(docs: DataFrame, columns: list, p: RepeatParams) -> DataFrame:
    """``columns``, the text's bytes and its ranges; at most a text's own ranges are gathered."""
    found = repeats(_keyed(docs, []), p)
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return _keyed(docs, columns).join(spans, ["k1", "k2"], "left").drop("k1", "k2")


def _disjoint(spans: list[dict] | None) -> list[tuple[int, int]]:
    if not spans:
        return []
    a, b = _merge(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    return list(zip(a.tolist(), b.tolist(), strict=True))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def report(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans; one row a document."""
    rows = _with_ranges(docs, ["doc_id"], p)

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for text, found in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                spans = _disjoint(found)
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(_kept(text, spans)).hexdigest())
                out["spans"].append([list(s) for s in spans])
            yield {"doc_id": batch.column("doc_id")} | out

    return arrow_map(rows, run, schema_of(rows, ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>"))


def _to_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spans`` drawn in to whole characters."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """``docs`` whose texts have lost their repeated bytes (whole characters only); same rows and columns."""
    rows = _with_ranges(docs, [carried(docs), "doc_id"], p).drop("doc_id")

    def run(batches):
        for batch in batches:
            cut, texts = [], []
            for text, found in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                spans = _to_characters(text, _disjoint(found))
                cut.append(bool(spans))
                texts.append(_kept(text, spans).decode("utf-8", "replace") if spans else None)
            yield {"_row": batch.column("_row"), "cut": cut, "cut_text": texts}

    return with_cut_texts(arrow_map(rows, run, schema_of(rows, ["_row"], "cut boolean, cut_text string")), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
