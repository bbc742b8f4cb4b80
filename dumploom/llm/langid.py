"""Language identification with a bit-sliced Bloom filter of character n-grams.

One array serves all languages: slot ``i`` holds a bit mask with one bit per language, and a
language's n-grams set its bit in the slots their hashes name. ANDing an n-gram's slots
returns every language that (probably) contains it in one step. A text's per-language
popcounts, corrected for each language's own false-positive rate, give the share of its
n-grams that the language knows; the language with the largest share wins.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a null id is never
learned from and not held out; texts are read whole, in blocks; without labelled rows every
text is ``und``; ties go to the alphabetically first language; repeated rows each get a row; no rows:
none; other columns are not looked at, whatever their names; any number of languages will do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import arrow_map, carried, forget, materialize, mix64, named, remainder, schema_of, unpacked

UNDETERMINED = "und"
ORDERS = (2, 3, 4)
BLOCK = 1 << 20  # symbols handled at once


@dataclass(frozen=True)
class LanguageParams:
    #: About so many different labelled texts a language are learned from; the counts are spread over the executors.
    sample_per_language: int = 3000
    #: n-grams rarer than this share of a language's n-grams of that order are left out, so a
    #: language adds at most 1 / min_share of each order, whatever the corpus.
    min_share: float = 2e-5
    min_count: int = 2
    bits_per_gram: int = 12
    hashes: int = 3
    sharpness: float = 20.0


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    slots: np.ndarray  # rows of masks, one row for each 64 languages; their length is a power of two
    false_positive: np.ndarray  # by language
    hashes: int
    sharpness: float


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _symbols(text: str):
    """Blocks of code points, lower-cased, with every run of other characters as one 0.

    Blocks overlap by the longest order less one, so that every n-gram is in exactly one block.
    """
    letter, carry = _is_letter(), np.zeros(1, np.uint32)
    for at in range(0, max(len(text), 1), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.where(letter[points], points, 0).astype(np.uint32)
        if at + BLOCK >= len(text):
            points = np.append(points, np.uint32(0))
        whole = np.concatenate([carry, points])
        keep = np.ones(len(whole), bool)
        keep[1:] = (whole[1:] != 0) | (whole[:-1] != 0)
        whole = whole[keep]
        yield whole, len(carry)
        carry = whole[-(max(ORDERS) - 1) :]


def _gram_hashes(text: str):
    """For each block, the hashes of its n-grams; a word's edges count as symbols, n-grams never cross words."""
    for s, seen in _symbols(text):
        s64, found = s.astype(np.uint64), []
        for n in ORDERS:
            if len(s) < n:
                continue
            first = max(0, seen - n + 1)
            ends = len(s) - n + 1
            h = np.full(ends, np.uint64(n), np.uint64)
            inner = np.ones(ends, bool)
            with np.errstate(over="ignore"):
                for k in range(n):
                    part = s64[k : k + ends]
                    h = h * np.uint64(0x100000001B3) + part
                    if 0 < k < n - 1:
                        inner &= part != 0
            if n == 2:
                inner &= (s64[:ends] != 0) | (s64[1 : 1 + ends] != 0)
            inner[:first] = False
            found.append(mix64(h[inner]))
        if found:
            yield np.concatenate(found)


def _counts(batches):
    """Partial n-gram counts of a partition's texts by language; merged by Spark."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield {"lang": [lang] * len(grams), "gram": grams.view(np.int64), "n": n}
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for h in _gram_hashes(text or ""):
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size > 8_000_000:
                    yield from flush()
                    size = 0
    yield from flush()


def fit(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from ``labelled`` (text, lang); null texts or languages teach nothing, copies once a language."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    key = F.xxhash64("text")
    distinct = rows.select("lang", key.alias("key")).distinct()
    sizes = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return LanguageModel((), np.zeros((1, 1), np.uint8), np.zeros(0), params.hashes, params.sharpness)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, params.sample_per_language / n))])
    draw = F.pmod(key, F.lit(1 << 20)) / float(1 << 20)
    sample = materialize(rows.where(draw < rate[F.col("lang")]).dropDuplicates(), "language-sample")
    counted = arrow_map(sample, _counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.create_map(*[F.lit(x) for x in _totals(sample).items() for x in x])
    common = counted.where((F.col("n") >= params.min_count) & (F.col("n") >= total[F.col("lang")] * params.min_share))
    table = common.select("lang", "gram").toArrow()
    forget(sample)
    return build_model(_by_language(table, sizes), params)


def _by_language(table, languages) -> dict[str, np.ndarray]:
    grams, langs = table.column("gram").to_numpy().view(np.uint64), np.array(table.column("lang").to_pylist(), object)
    return {x: grams[langs == x] for x in languages}


def build_model(grams: dict[str, np.ndarray], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """The bit-sliced array of each language's n-gram hashes; beyond 64 languages a slot has several words."""
    languages = tuple(sorted(grams))
    n, most = len(languages), max([1, *map(len, grams.values())])
    width = np.uint8 if n <= 8 else np.uint16 if n <= 16 else np.uint64
    slots = np.zeros((-(-n // 64), 1 << int(np.ceil(np.log2(most * params.bits_per_gram)))), width)
    for bit, lang in enumerate(languages):
        for at in _slots_of(grams[lang], slots.shape[1], params.hashes):
            np.bitwise_or.at(slots[bit // 64], at, width(1 << bit % 64))
    fill = np.array([((slots[b // 64] >> width(b % 64)) & width(1)).mean() for b in range(n)])
    return LanguageModel(languages, slots, fill**params.hashes, params.hashes, params.sharpness)


def _totals(sample: DataFrame) -> dict[str, float]:
    """n-grams of one order a language, near enough: one starts at each character."""
    got = sample.groupBy("lang").agg(F.sum(F.length("text")).cast("double").alias("n")).collect()
    return {r.lang: r.n or 0.0 for r in got} or {"": 0.0}


def _slots_of(grams: np.ndarray, size: int, hashes: int):
    mask, low, high = np.uint64(size - 1), grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32)
    for k in range(hashes):
        yield ((low + np.uint64(k) * (high | np.uint64(1))) & mask).astype(np.int64)


def score_text(model: LanguageModel, text: str | None) -> tuple[str, float, float]:
    """(language, score, share of the n-grams that the language knows)."""
    hits, total = np.zeros(len(model.languages), np.int64), 0
    for grams in _gram_hashes(text or ""):
        for word, masks in enumerate(model.slots):
            mask = None
            for at in _slots_of(grams, len(masks), model.hashes):
                mask = masks[at] if mask is None else mask & masks[at]
            counts = np.bincount(mask, minlength=256) if mask.dtype == np.uint8 else None
            for b in range(min(64, len(hits) - 64 * word)):
                if counts is None:
                    hits[64 * word + b] += int(((mask >> mask.dtype.type(b)) & mask.dtype.type(1)).sum())
                else:
                    hits[b] += int(counts[_with_bit(b)].sum())
        total += len(grams)
    if not total or not len(hits):
        return UNDETERMINED, 0.0, 0.0
    share = np.clip((hits / total - model.false_positive) / (1 - model.false_positive), 0, 1)
    power = np.exp(model.sharpness * min(1.0, total / 50) * (share - share.max()))
    best = int(share.argmax())
    return model.languages[best], float(power[best] / power.sum()), float(share[best])


@lru_cache(8)
def _with_bit(b: int) -> np.ndarray:
    return np.arange(256)[(np.arange(256) >> b) & 1 == 1]


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score, known_share from the whole of ``text`` alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most languages / min_share n-grams of each order
    kept = docs.select(*map(named, keep), F.col("text").cast("string").alias("_lang_text"))

    def rows(batches):
        for batch in batches:
            found = [score_text(shared.value, t) for t in batch.column("_lang_text").to_pylist()]
            out = {name: batch.column(name) for name in keep}
            yield out | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "known_share": [x[2] for x in found]}

    return arrow_map(kept, rows, schema_of(kept, keep, "lang_pred string, score double, known_share double"))


def keep_known(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """``docs`` in a language that the model knows, at least ``least`` of their n-grams known; same columns, whatever their names."""
    found = predict(docs.select(carried(docs), "text"), model, ("_row",))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("known_share") >= least)).select(*unpacked(docs.schema))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: crc32 of the id modulo 4 is not 2 (nor is the id null)."""
    return docs.where(remainder("doc_id", 4) != 2)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, ("doc_id", "held_out"))
