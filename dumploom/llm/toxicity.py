"""Toxicity: a subsequence-string-kernel support vector machine on Nyström landmarks.

Words are compared by their common subsequences of three letters, a letter in between
costing ``decay`` and other signs nothing, so a gapped insult or one with characters put in keeps
most of its similarity. Landmarks
are character runs that training texts with label 1 have far more often than others. A
sentence's kernel row is, for each landmark, the largest similarity among its words
(k(word, landmark) / k(landmark, landmark), at most 1, squared; below ``least`` 0); the landmarks'
kernel matrix to the power -1/2 makes it a Nyström feature vector. A linear machine (squared
hinge) is trained on sentences: labels belong to texts, so each positive text stands for its most
toxic sentence, chosen anew between fits. A logistic curve over a text's worst
sentences and its length, fitted on the training texts, turns margins into scores.

Learning uses a bounded sample of different labelled texts (``most_positive``, ``most_negative``);
scoring is one narrow pass over whole texts.

Edge cases: null and empty texts score as a sentence without any similarity; without
labelled rows of both kinds every text scores the share of label 1 (0 without labels); repeated
label rows of an id count once, the larger label winning; null ids are never learned from; very long
texts are read in blocks cut at sentence ends (a sentence of a million characters at a blank); no rows: none; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations
from unicodedata import normalize

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dumploom.llm.common import arrow_map, forget, materialize, named, remainder, schema_of

OFFSETS = tuple((a, b) for a, b in combinations(range(1, 5), 2))  # of a subsequence's second and third characters
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "@": "a", "$": "s"}
GROUP = 1 << 20  # characters scored at once
_SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){3,}(?!\S)")


@dataclass(frozen=True)
class ToxicityParams:
    most_positive: int = 2000  # training texts of label 1, about
    most_negative: int = 4500
    landmarks: int = 64
    candidates: int = 400  # runs ranked for landmarks
    support: float = 0.02  # a landmark is in at least this share of the texts of label 1
    run_lengths: tuple[int, ...] = (4, 5, 6, 8, 10)
    odds: float = 3.0  # and this many times (log) likelier in them
    decay: float = 0.8
    least: float = 0.45
    sentences: int = 8  # of a training text, those with the largest similarities; scoring takes all
    cost: float = 50.0
    rounds: int = 4


@dataclass(frozen=True)
class ToxicityModel:
    codes: np.ndarray  # row of a subsequence in ``weights``, or -1
    weights: np.ndarray  # by landmark, over its own kernel value
    whiten: np.ndarray
    machine: np.ndarray  # the last is the bias
    curve: np.ndarray  # over a text's evidence; the last is the constant
    params: ToxicityParams


@lru_cache(1)
def _classes() -> np.ndarray:
    """1 to 26 for a-z (marks dropped, some look-alikes), 27 to 62 for other letters, 0 for the rest."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if c < 128:
            ch = LOOK_ALIKES.get(ch, ch)
        elif ch.isalpha():
            ch = normalize("NFKD", ch)[0].lower()[:1]
        if "a" <= ch <= "z" or "A" <= ch <= "Z":
            table[c] = ord(ch.lower()) - 96
        elif ch.isalpha():
            table[c] = 27 + c % 36
    return table


def _subsequences(classes: np.ndarray, decay: float):
    """(code, weight, first position) arrays of the three-character subsequences, by offset; boundaries not looked at."""
    c = classes.astype(np.int32)
    for a, b in OFFSETS:
        if len(c) > b:
            n = len(c) - b
            yield (c[:n] << 12) | (c[a : a + n] << 6) | c[b:], decay ** (b - 2), b


def kernel_map(word: str, decay: float) -> Counter:
    """The weights of a word's subsequences; their inner products are the kernel."""
    classes, out = _classes()[np.frombuffer(word.encode("utf-32-le"), np.uint32)], Counter()
    for codes, weight, b in _subsequences(classes, decay):
        for k, code in enumerate(codes.tolist()):
            if code >> 12 and code >> 6 & 63 and code & 63:
                out[code] += weight
    return out


def _inner(x: Counter, y: Counter) -> float:
    return sum(v * y[k] for k, v in x.items() if k in y)


def sentence_rows(model: ToxicityModel, texts: list[str]):
    """For each text its sentences' kernel rows, those without any similarity left out."""
    spaced = [_SPACED.sub(lambda m: m[0].replace(" ", ""), t) for t in texts]
    points = np.frombuffer("\n".join(spaced).encode("utf-32-le", "replace"), np.uint32)
    classes = _classes()[points]
    space = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0x85) | (points == 0xA0) | (points == 0x3000)
    word = np.cumsum(space).astype(np.int32)
    at, value, row = [], [], []
    letters = np.flatnonzero(classes)  # signs between a word's letters are no gap
    of = word[letters]
    for codes, weight, b in _subsequences(classes[letters], model.params.decay):
        got = model.codes[codes]
        hit = np.flatnonzero(got >= 0)
        hit = hit[of[hit] == of[hit + b]]
        at.append(of[hit])
        row.append(got[hit])
        value.append(np.full(len(hit), weight, np.float32))
    out = [np.zeros((0, model.weights.shape[1]), np.float32)] * len(texts)
    if not at or not len(points):
        return out
    at, row, value = map(np.concatenate, (at, row, value))
    most = np.bincount(at, value * model.weights.max(axis=1)[row], minlength=int(word[-1]) + 1)
    keep = most[at] >= model.params.least
    at, row, value = at[keep], row[keep], value[keep]
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    at, row, value = at[order], row[order], value[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    words = at[first]
    parts = []
    bounds = np.append(first, len(at))
    for k in range(0, len(first), 20_000):
        lo, hi = bounds[k], bounds[min(k + 20_000, len(first))]
        parts.append(np.add.reduceat(model.weights[row[lo:hi]] * value[lo:hi, None], first[k : k + 20_000] - lo, axis=0))
    near = np.minimum(np.concatenate(parts), 1) ** 2
    near[near < model.params.least**2] = 0
    ends = ((points == 46) | (points == 33) | (points == 63)) & np.append(space[1:], True) | (points == 10)
    sentence = np.cumsum(np.append(False, ends[:-1])).astype(np.int32)
    starts = np.append(0, np.flatnonzero(space) + 1)  # of words
    own = sentence[np.minimum(starts[words], len(points) - 1)]
    lengths = np.array([len(t) + 1 for t in spaced])
    text = np.searchsorted(np.cumsum(lengths), np.minimum(starts[words], len(points) - 1), "right")
    cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])))
    pooled = np.maximum.reduceat(near, cut, axis=0)
    filled = pooled.any(axis=1)
    pooled, owner = pooled[filled], text[cut][filled]
    for k, lo in zip(*np.unique(owner, return_index=True), strict=True):
        out[k] = pooled[lo : np.searchsorted(owner, k, "right")]
    return out


def evidence(model: ToxicityModel, rows: np.ndarray, length: int) -> list[float]:
    """A text's margin (its worst sentence), that of the next worst, the sentences beyond 0, and its length; all sentences are looked at."""
    w, bias = model.machine[:-1], model.machine[-1]
    margins = rows @ (model.whiten @ w) + bias if len(rows) else np.zeros(0)
    top = np.maximum(np.append(np.sort(margins)[::-1][:2], (bias, bias)), bias)
    beyond = (margins > 0).sum() + 2 * (bias > 0)
    return [float(top[0]), float(top[1]), float(np.log1p(beyond)), float(np.log1p(length / 1000))]


def worst(rows: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` sentences with the largest similarities."""
    return rows[np.argsort(-rows.sum(axis=1), kind="stable")[:n]]


def scores(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    if not model.weights.size:
        return np.full(len(texts), model.curve[-1])
    found = [evidence(model, r, len(t or "")) for r, t in zip(_in_groups(model, texts), texts, strict=True)]
    x = np.array(found).reshape(len(texts), -1)
    return 1 / (1 + np.exp(-np.clip(x @ model.curve[:-1] + model.curve[-1], -30, 30)))


def _runs(params: ToxicityParams):
    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            if counts:
                yield {"run": list(counts), "pos": [v[1] for v in counts.values()], "neg": [v[0] for v in counts.values()]}
                counts.clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen = set()
                for w in set(re.findall(r"[^\W\d_]+", text.lower())):
                    seen.update(w[i : i + n] for n in params.run_lengths for i in range(len(w) - n + 1))
                for r in seen:
                    counts.setdefault(r, [0, 0])[label] += 1
                if len(counts) > 1_000_000:
                    yield from flush()
        yield from flush()

    return run


def pick_landmarks(sample: DataFrame, sizes: dict[int, int], params: ToxicityParams) -> list[str]:
    """Runs that mark label 1, most telling first, each unlike those before it."""
    counted = arrow_map(sample, _runs(params), "run string, pos long, neg long").groupBy("run").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / sizes[1] * sizes[0] / (F.col("neg") + 0.5))
    telling = counted.where((F.col("pos") >= max(2.0, params.support * sizes[1])) & (odds > params.odds))
    ranked = telling.select("run", (F.col("pos") * odds * F.pow(F.length("run"), F.lit(0.2))).alias("weight"))
    chosen: list[str] = []
    maps: list[Counter] = []
    for r in ranked.orderBy(F.desc("weight"), "run").limit(params.candidates).collect():
        mine = kernel_map(r.run, params.decay)
        own = _inner(mine, mine)
        if own and all(max(_inner(mine, m) / own, _inner(mine, m) / _inner(m, m)) < 0.8 for m in maps):
            chosen.append(r.run)
            maps.append(mine)
            if len(chosen) == params.landmarks:
                break
    return chosen


def _with_landmarks(marks: list[str], params: ToxicityParams) -> ToxicityModel:
    maps = [kernel_map(z, params.decay) for z in marks]
    own = np.array([_inner(m, m) for m in maps])
    every = sorted(set().union(*maps))
    codes = np.full(1 << 18, -1, np.int16 if len(every) < 1 << 15 else np.int32)
    codes[every] = np.arange(len(every))
    weights = np.array([[m.get(c, 0.0) / o for m, o in zip(maps, own, strict=True)] for c in every], np.float32)
    gram = np.array([[_inner(x, y) for y in maps] for x in maps]) / np.sqrt(np.outer(own, own))
    values, vectors = np.linalg.eigh(gram**2)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    return ToxicityModel(codes, weights, whiten, np.zeros(len(marks) + 1), np.zeros(5), params)


def train_machine(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """A linear support vector machine with squared hinge, classes weighing the same; finite Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y <= 0).sum(), 1)) * cost * 200
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(40):
        active = y * (x1 @ w) < 1
        a = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = (w + new) / 2 if _ > 20 else new
    return w


def fit_curve(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A logistic curve over a text's evidence, its targets kept off 0 and 1; Newton steps."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w)) * 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + ridge
        step = np.linalg.solve(h, x1.T @ (p - target) + ridge @ w)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return w


def text_key() -> F.Column:
    """By which texts are sampled and told apart."""
    return F.xxhash64(F.col("text").cast("string"), F.lit(9))


def fit(labelled: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from ``labelled`` (text, label 0 or 1; its ``key``, if there, is ``text_key``). Copies of a text count once a label."""
    key = F.col("key") if "key" in labelled.columns else text_key()
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"), key.alias("key"))
    rows = rows.where("text is not null and label in (0, 1)")
    distinct = rows.groupBy("label", "key").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    sizes = {r.label: (r.texts, r.n) for r in distinct.collect()}
    empty = np.zeros((0, 0), np.float32)
    share = sizes[1][1] / sum(n for _, n in sizes.values()) if 1 in sizes else 0.0
    constant = ToxicityModel(np.zeros(0, np.int16), empty, empty, np.zeros(1), np.array([share]), params)
    if len(sizes) < 2:
        return constant
    most = {0: params.most_negative / sizes[0][0], 1: params.most_positive / sizes[1][0]}
    draw = F.pmod("key", F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(draw < max(most.values()))  # of the texts alone, so it comes before a join with labels
    drawn = drawn.where(draw < F.when(F.col("label") == 1, most[1]).otherwise(most[0]))
    sample = materialize(drawn.select("text", "label").dropDuplicates(), "toxicity-sample")
    taken = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    marks = pick_landmarks(sample, sizes={k: max(1, taken.get(k, 0)) for k in (0, 1)}, params=params)
    if not marks:
        return constant
    model = _with_landmarks(marks, params)
    shared = sample.sparkSession.sparkContext.broadcast(model)  # bounded by the number of landmarks

    def features(batches):
        for batch in batches:
            labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
            best = [worst(r, params.sentences).astype(np.float32).ravel().tolist() for r in _in_groups(shared.value, texts)]
            yield {"label": labels, "rows": best}

    got = arrow_map(sample, features, "label int, rows array<float>").collect()  # bounded by the sample
    label = np.array([r.label for r in got])
    kernel = [np.array(r.rows, np.float64).reshape(-1, len(marks)) for r in got]
    kernel = [k if len(k) else np.zeros((1, len(marks))) for k in kernel]
    rows = [k @ model.whiten for k in kernel]
    negative = np.concatenate([r for r, y in zip(rows, label, strict=True) if y == 0] or [np.zeros((1, len(marks)))])
    positive = [r for r, y in zip(rows, label, strict=True) if y == 1]
    # Sentences with a landmark as good as whole are positive from the start, whatever the witness.
    sure = [r[k.max(axis=1) >= 0.8] for r, k, y in zip(rows, kernel, label, strict=True) if y == 1]
    if not positive:
        return constant
    witness = [0] * len(positive)
    for _ in range(params.rounds):
        x = np.vstack([*(r[k] for r, k in zip(positive, witness, strict=True)), *sure, negative])
        w = train_machine(x, np.r_[np.ones(len(x) - len(negative)), -np.ones(len(negative))], params.cost)
        now = [int((r @ w[:-1]).argmax()) for r in positive]
        if now == witness:
            break
        witness = now
    trained = replace(model, machine=w)
    shared_machine = sample.sparkSession.sparkContext.broadcast(trained)

    def evidences(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [evidence(shared_machine.value, r, len(t)) for r, t in zip(_in_groups(shared_machine.value, texts), texts, strict=True)]
            yield {"label": batch.column("label"), "known": found}

    known = arrow_map(sample, evidences, "label int, known array<double>").collect()  # bounded by the sample
    forget(sample)
    shared.unpersist()
    shared_machine.unpersist()
    return replace(trained, curve=fit_curve(np.array([r.known for r in known]), np.array([float(r.label) for r in known])))


def _in_groups(model: ToxicityModel, texts: list[str | None]):
    """``sentence_rows`` of a batch, about ``GROUP`` characters at a time; longer texts by blocks of lines."""
    group, size = [], 0
    for text in texts:
        text = (text or "").lower()
        if len(text) > 4 * GROUP:
            if group:
                yield from sentence_rows(model, group)
                group, size = [], 0
            parts, at = [], 0
            while at < len(text):
                cut = len(text)
                if at + GROUP < len(text):  # at the end of a sentence, else of a word, else anywhere
                    cut = max(text.rfind(mark, at, at + GROUP) for mark in ("\n", ". ", "! ", "? ")) + 1
                    cut = cut if cut > at else text.rfind(" ", at, at + GROUP) + 1
                    cut = cut if cut > at else at + GROUP
                parts += sentence_rows(model, [text[at:cut]])
                at = cut
            yield np.concatenate(parts)
            continue
        group.append(text)
        size += len(text)
        if size > GROUP:
            yield from sentence_rows(model, group)
            group, size = [], 0
    if group:
        yield from sentence_rows(model, group)


def predict(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score, from the whole of ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of landmarks
    rows = docs.select(*map(named, keep), F.col("text").cast("string").alias("_toxic_text"))

    def run(batches):
        for batch in batches:
            yield {c: batch.column(c) for c in keep} | {"score": scores(shared.value, batch.column("_toxic_text").to_pylist())}

    return arrow_map(rows, run, schema_of(rows, keep, "score double"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, its key and label of rows that may be learned from: crc32 of the id modulo 3 is not 1 (nor is the id null)."""
    marks = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", 3) != 1))
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").alias("_doc"), "text", text_key().alias("key"))
    return rows.join(marks, F.col("_doc") == F.col("_id")).select("text", "key", "label")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(training_rows(docs.select("doc_id", "text"), labels))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    found = predict(docs.select("doc_id", held, "text"), model, ("doc_id", "held_out"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
