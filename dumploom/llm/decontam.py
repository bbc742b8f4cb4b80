"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all (normalised) test items recognises every run of words that occurs in an
item. Training words are streamed through it; the current state and match length tell, at each
word, the longest run ending there. A run of at least ``window`` words, or a whole shorter
item, is a leak. Words off the items' vocabulary, and words whose pair with the next is in no
item, reset the automaton without a Python step each.

Edge cases: null or wordless texts have no words and hit nothing; items without words match
nothing; items with equal ids count once; a null item id counts and is written as an empty
string; texts are read whole, very long ones as a stream; no items: nothing is contaminated; no
documents: no rows; other columns of documents stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import WORD_TABLE, arrow_map, carried, named, schema_of, text_bytes, utf8, with_cut_texts, words_of

WINDOW = 8
#: Words of items in one automaton. More items make more automata, applied one after another.
BLOCK_WORDS = 400_000
STREAM_BYTES = 8 << 20


class SuffixAutomaton:
    """States are classes of word runs with equal ends; built item by item from the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: (run length, state) -> the items with such a run: windows, and whole shorter items.
        self.found: dict[tuple[int, int], set[str]] = {}
        pairs = set()
        for name, ids in coded:
            state, length = 0, 0
            size = min(window, len(ids))
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= size:
                    self.found.setdefault((size, self.at(state, size)), set()).add(name)
            pairs.update(zip(ids, ids[1:], strict=False))
        self.sizes = sorted({size for size, _ in self.found})
        self.frozen = {k: tuple(sorted(v)) for k, v in self.found.items()}
        width = len(self.vocab)
        self.pairs = np.array(sorted(a * width + b for a, b in pairs), np.int64)

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the runs of ``q`` no longer than length(p) + 1; ``p``'s side now leads there."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and length of the longest run ending with the word ``c``."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        q = self.next[state].get(c)
        return (0, 0) if q is None else (q, length + 1)

    def at(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of known words, each pair of which occurs in an item, as long as the shortest window."""
        if not len(ids) or not self.sizes:
            return
        joined = np.zeros(len(ids), bool)  # with the word before
        if len(self.pairs):
            keys = ids[:-1] * len(self.vocab) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == keys) & (ids[:-1] >= 0) & (ids[1:] >= 0)
        starts = np.flatnonzero(~joined)
        ends = np.append(starts[1:], len(ids))
        fit = (ends - starts >= self.sizes[0]) & (ids[starts] >= 0)
        yield from zip(starts[fit].tolist(), ends[fit].tolist(), strict=True)

    def leaks(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, merged runs of hit words as [first, end), names of the items found)."""
        if len(text) > STREAM_BYTES:
            return self._stream(m[0] for m in re.finditer(rb"[^ ]+", text.translate(WORD_TABLE)))
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, _missing(len(words))), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in self.stretches(ids):
            state, length = 0, 0
            for p, c in enumerate(ids[a:b].tolist(), a):
                state, length = self.step(state, length, c)
                self._note(state, length, p, spans, items)
        return len(words), spans, items

    def _stream(self, words) -> tuple[int, list[tuple[int, int]], set[str]]:
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = n = 0
        for n, w in enumerate(words, 1):
            c = self.vocab.get(w, -1)
            state, length = self.step(state, length, c) if c >= 0 else (0, 0)
            if length:
                self._note(state, length, n - 1, spans, items)
        return n, spans, items

    def _note(self, state: int, length: int, p: int, spans: list, items: set) -> None:
        for size in self.sizes:
            if size <= length and (names := self.frozen.get((size, self.at(state, size)))):
                items.update(names)
                first = p - size + 1
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, p + 1))


def _missing(n: int):
    return (-1 for _ in range(n))


@dataclass(frozen=True)
class LeakLimits:
    """What removal does: a text with at least ``max_items`` items, or with more than ``max_coverage``
    of its words in leaks, goes as a whole; else its leaking spans are cut out."""

    max_items: int = 2
    max_coverage: float = 0.5


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of ``items`` (item_id, text), each of a bounded number of words; items pass the driver one by one."""
    block, size, some = [], 0, False
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes("text").alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(bytes(row.text))
        block.append((row.item_id, words))
        size += len(words)
        if size >= block_words:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
            some = True
    if block or not some:  # one at least, so that words are counted
        yield SuffixAutomaton(block, window)


def find_leaks(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep``, the UTF-8 text, n_words, leaks (runs of word numbers) and items, one row a document.

    Narrow at any size: each automaton is one pass of mapInArrow over the rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        *map(named, keep), text_bytes("text").alias("_text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<array<bigint>>").alias("leaks"), F.lit(None).cast("array<string>").alias("items"),
    )
    schema = rows.schema
    for automaton in automata(items, window, block_words):
        shared = spark.sparkContext.broadcast(automaton)  # bounded by block_words

        def scan(batches, shared=shared):
            for batch in batches:
                n_words, leaks, names = [], [], []
                earlier = zip(batch.column("leaks").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for text, (spans, items) in zip(utf8(batch.column("_text")), earlier, strict=True):
                    n, own, found = shared.value.leaks(text)
                    n_words.append(n)
                    leaks.append(_merged([*map(tuple, spans or []), *own]))
                    names.append(sorted({*(items or []), *found}))
                yield {c: batch.column(c) for c in (*keep, "_text")} | {"n_words": n_words, "leaks": leaks, "items": names}

        rows = arrow_map(rows, scan, schema)
    return rows


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: bytes, spans: list) -> bytes:
    """``text`` without the bytes from each span's first word to its last."""
    if not spans:
        return text
    bounds, kept, at = iter(spans), [], 0
    first, end = next(bounds)
    for n, m in enumerate(re.finditer(rb"[^ ]+", text.translate(WORD_TABLE))):
        if n == first:
            kept.append(text[at : m.start()])
        if n == end - 1:
            at = m.end()
            if (follow := next(bounds, None)) is None:
                break
            first, end = follow
    return b"".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, limits: LeakLimits = LeakLimits(), window: int = WINDOW) -> DataFrame:
    """``docs`` without leaks: rows over a limit go, other rows lose their leaking spans; same columns."""
    found = find_leaks(docs.select(carried(docs), F.col("text")), items, ("_row",), window)
    hit = F.expr("aggregate(leaks, 0L, (n, x) -> n + x[1] - x[0])")
    good = found.where((F.size("items") < limits.max_items) & (hit <= F.col("n_words") * limits.max_coverage))

    def cut(batches):
        for batch in batches:
            leaks = batch.column("leaks").to_pylist()
            texts = [cut_words(t, s).decode("utf-8", "replace") if s else None for t, s in zip(utf8(batch.column("_text")), leaks, strict=True)]
            yield {"_row": batch.column("_row"), "cut": [bool(s) for s in leaks], "cut_text": texts}

    rows = arrow_map(good.select("_row", "_text", "leaks"), cut, schema_of(good, ["_row"], "cut boolean, cut_text string"))
    return with_cut_texts(rows, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_leaks(docs, items)
    return found.select(
        "doc_id", "n_words", F.expr("aggregate(leaks, 0L, (n, x) -> n + x[1] - x[0])").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


#: The same by brute force over windows, for DuckDB.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS size, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS run
    FROM b, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS run FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hit AS (SELECT dw.rid, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.run = bw.run AND dw.size = bw.size),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS t(p) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
