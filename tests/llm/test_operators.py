"""Each operator against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from dumploom.llm import bpe, decontam, html_extract, langid, ngram_join, shards, suffix_dedup, token_files, toxicity, vector_join
from dumploom.llm.common import words_of


def texts_of(spark, folder, table="documents"):
    return spark.read.parquet(f"{folder}/{table}.parquet").toPandas()


# 1


def test_language_held_out(spark, small):
    docs = texts_of(spark, small)
    got = langid.query(spark, small).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert got.held_out.equals(got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd_docs, small):
    model = langid.fit(langid.training_rows(spark.read.parquet(f"{small}/documents.parquet")))
    got = langid.predict(odd_docs, model).toPandas()
    assert len(got) == 12
    assert sorted(got.lang_pred)[-5:] == ["und"] * 5  # null twice, empty, blank, digits
    nothing = langid.predict(odd_docs, langid.fit(odd_docs.limit(0))).toPandas()
    assert set(nothing.lang_pred) == {"und"}


def test_language_blocks_count_each_gram_once(monkeypatch):
    text = "Straße und Größe, çà et là! " * 40
    whole = np.sort(np.concatenate(list(langid._gram_hashes(text))))
    monkeypatch.setattr(langid, "BLOCK", 17)
    assert (np.sort(np.concatenate(list(langid._gram_hashes(text)))) == whole).all()


# 2

PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site</header>
<nav><a href="/">Home</a></nav><div class="sidebar">s</div><div class="post-{n}"><h1>A &amp;&nbsp; b</h1><p>one<br>two <b>bold</b>
<ul><li>x<li>y</ul><form>f</form><div class="ad-box">buy</div><p>{body}</p></div><section id="comments"><p>c</p></section><footer>z</footer>"""


def test_extraction(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(n=i, body="long text " * 20)) for i in range(6)]
    rows += [(6, "http://h0.org/short", PAGE.format(n=9, body="s")), (7, None, "<p>cut &am"), (8, "x", None), (9, "http://h0.org/", ""), (9, "http://h0.org/", "")]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "\n".join(["A & b", "one two bold", "x", "y", ("long text " * 20).strip()])
    assert got[6].text == "A & b\none two bold\nx\ny\ns"
    assert (got[7].text, got[8].text, got[9].n_chars) == ("cut &am", "", 0)
    assert got[0].path == got[6].path == "/html/body/div.post-#"


# 3


@pytest.fixture(scope="module")
def encoders():
    own = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_library(encoders):
    own, library = encoders
    rng = random.Random(1)
    cases = ["", "a" * 5000, " " * 3000 + "x", "!?" * 2000, "日本語" * 500, "it's I'LL  x\n\n y²Ⅷª½", "<|endoftext|>"]
    cases += ["".join(rng.choice(a) for _ in range(rng.randint(1, 900))) for a in ("ab", "the in", "!?.=-", "éàüñßthe", "日本語の") for _ in range(20)]
    for text in cases:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_join_is_associative(encoders):
    own, _ = encoders
    rng = random.Random(2)
    for _ in range(200):
        a, b, c = (bytes(rng.choice(b"thein gs!") for _ in range(rng.randint(0, 40))) for _ in range(3))
        whole = own.leaf(a + b + c)
        assert own.join(own.join(own.leaf(a), own.leaf(b)), own.leaf(c)) == own.join(own.leaf(a), own.join(own.leaf(b), own.leaf(c))) == whole


def test_bpe_odd_rows(odd_docs, encoders):
    got = bpe.encode_documents(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("doc_id", "n_chars")).collect()
    want = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())
    assert Counter(r.decoded_sha256 for r in got) == want


# 4


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


@pytest.mark.parametrize("most", [1500, 1])
def test_repeats_equal_brute_force(spark, most):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    texts += [texts[i] for i in range(4)] + [t[:50] + passage + t[50:] for t in texts[4:16]] + ["xyz " * 60, "xyz " * 50, None, ""]
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string")
    params = suffix_dedup.RepeatParams(length=40, gram=8, most_contexts=most, transform_bytes=4000)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.report(docs, params).collect())
    raw = [(t or "").encode() for t in texts]
    want = Counter((i % 40, len(t), int(m.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()) for i, (t, m) in enumerate(zip(raw, brute_repeats(raw, 40))))
    assert got == want


def test_repeats_in_blocks(spark):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 3000).astype(np.uint8)
    text[2000:2500] = text[100:600]
    docs = spark.createDataFrame([(1, 2, bytes(text))], "k1 long, k2 long, text binary")
    spans = suffix_dedup._disjoint([r.asDict() for r in suffix_dedup.repeats(docs, suffix_dedup.RepeatParams(block=300)).collect()])
    mask = brute_repeats([bytes(text)], 400)[0]
    assert mask.sum() >= 1000 and spans == [(int(a), int(b)) for a, b in np.flatnonzero(np.diff(np.r_[0, mask, 0])).reshape(-1, 2)]


def test_remove_repeats_keeps_columns(odd_docs):
    got = suffix_dedup.remove_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    rows = {(r.doc_id, r.source): r.text for r in got.collect()}
    assert rows[4, "x"] == rows[5, "y"] == "" and rows[9, "x"] == "word" and rows[1, "x"] is None
    assert got.where("doc_id = 4").first().n_chars == 0
    assert suffix_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


# 5


def test_token_files(spark, odd_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    literals = [(20, "a <|endoftext|> b", "en", "x", 17, "e"), (21, "<|StartOfText|><|startoftext|>", "en", "x", 30, "e")]
    odd_docs = odd_docs.union(spark.createDataFrame(literals, odd_docs.schema))
    folder = token_files.scratch_path(spark, "t")
    form = token_files.FileFormat(sequence_length=32, sequences_per_batch=4, bytes_per_file=4000)
    files = token_files.write_files(odd_docs, folder, P.path("word_bpe_49k.json"), form=form)
    got = token_files.read_files(spark, folder, files).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[0].doc_id is None
    store, path = token_files.file_system(folder)
    reader = token_files.SequenceReader(pa.memory_map(f"{path}/{files[-1]['file']}.arrow"))
    tail, mask = reader.sequence((files[-1]["n_tokens"] - 1) // 32)
    assert len(tail) == 32 and sum(mask.to_pylist()) == (files[-1]["n_tokens"] - 1) % 32 + 1
    assert token_files.write_files(odd_docs.limit(0), folder + "-none", P.path("word_bpe_49k.json")) == []


# 6


def check_shards(docs, got, shards_n, slack):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(load.values()) / shards_n
    assert all(abs(load[s] - fair) <= slack * fair for s in range(shards_n)), load


def test_shards(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 50)).otherwise(F.repeat(F.concat(F.lit("t"), "id"), (F.col("id") % 40).cast("int"))).alias("text"))
    got = shards.assign(docs, shards.ShardParams(shards=8)).collect()
    check_shards(docs.collect(), got, 8, 0.03)
    assert {r.law for r in got} == {"bytes"}
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 1  # the hot group alone


def test_shards_odd_rows(odd_docs):
    got = shards.assign(odd_docs).collect()
    assert len(got) == 12 and all(0 <= r.shard < 40 for r in got)
    assert sum(r.size for r in got if r.doc_id == 1) == 16
    assert shards.assign(odd_docs.limit(0)).count() == 0


# 7


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 24))
    rows = np.vstack([base, *(base[i % 20] + rng.standard_normal(24) * s for i, s in enumerate(rng.uniform(0.05, 0.4, 150))), base[:10], base[:10] * 3])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    data += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None, 1.0]), (1005, [float("inf"), 1.0]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0, 2.0])]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(rows), dtype=bool)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
    for chunk in (3000, 20):
        got = {r.vec_id: r for r in vector_join.near_vectors(docs, vector_join.VectorParams(chunk=chunk)).collect()}
        assert len(got) == len(data)
        for i in range(len(rows)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
        assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006))
        assert got[1006].n_links == got[1007].n_links == got[None].n_links == 2 and got[1007].component_id == 1006


# 8


def brute_leaks(text, items, window=8):
    words, hit, found = words_of(text.encode()), set(), set()
    for name, item in items:
        w = words_of((item or "").encode())
        n = min(window, len(w))
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [400_000, 15])
def test_leaks_equal_brute_force(spark, block):
    rng = random.Random(8)
    items = [(f"i{k}", " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 20)))) for k in range(12)] + [("z", None), ("y", "Q R"), ("y", "r q")]
    texts = [" ".join(rng.choice("abcdefgQR") for _ in range(rng.randint(0, 120))) for _ in range(80)] + [None, "", "A, b-c D!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in decontam.find_leaks(docs, bench, block_words=block).collect():
        n, hit, found = brute_leaks(texts[r.doc_id] or "", items)
        assert (r.n_words, sum(b - a for a, b in r.leaks), r["items"]) == (n, hit, found)
    automaton = decontam.SuffixAutomaton([(k, words_of((t or "").encode())) for k, t in items])
    for t in filter(None, texts):
        assert automaton._stream(iter(words_of(t.encode())))[1:] == automaton.leaks(t.encode())[1:]


def test_leak_removal(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"Before {item}. After it all is well and many more words follow here, so that they are most", 0), (2, item, 0), (3, "clean", 5), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert set(got) == {1, 3, 4} and "two three" not in got[1].text and got[1].text.startswith("Before ") and got[1].n_chars == len(got[1].text)
    assert (got[3].text, got[3].n_chars, got[4].text) == ("clean", 5, None)


# 9


def test_toxicity_learns_gapped_insults(spark):
    rng = random.Random(9)
    syllables = ["er", "in", "the", "at", "ou", "re", "sh", "ly", "an", "ti"]
    say = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(f"{say(12)}. {say(5)} {w} {say(5)}. {say(8)} {w}." if y else f"{say(20)}. {say(12)}.", y) for y in (0, 1) for w in ("grumblox", "fizzwack", "plonkerd") for _ in range(40)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    bad = toxicity.scores(model, ["the grumblox ly. Fizzwack er.", "you p.l.o.n.k.e.r.d. And g r u m b l o x."])
    good = toxicity.scores(model, ["the er in. ly at the re.", "", None, say(300)])
    assert bad.min() > 0.5 > good.max()
    assert bad[0] > 0.7


def test_toxicity_odd_rows(spark, odd_docs, small):
    got = toxicity.query(spark, small).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    constant = toxicity.fit(spark.createDataFrame([("x", 1)], "text string, label int"))
    assert set(toxicity.predict(odd_docs, constant).toPandas().score) == {1.0}


# 10


def brute_links(texts, t=0.8):
    sets = []
    for x in texts:
        w = words_of((x or "").encode())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    m = len(sets)
    near = np.zeros((m, m), bool)
    for i in range(m):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                near[i, j] = near[j, i] = both / (len(sets[i]) + len(sets[j]) - both) >= t
    label = np.arange(m)
    for _ in range(m):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(m)])
    return near.sum(axis=1), label


@pytest.mark.parametrize("chunk", [1500, 7])
def test_near_duplicates_equal_brute_force(spark, chunk):
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))) for _ in range(40)]
    for _ in range(120):
        w = rng.choice(texts[:12]).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [None, "", "one", "One!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, label = brute_links(texts)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs, ngram_join.JoinParams(chunk=chunk)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].class_id, got[i].kept) == (links[i], label[i], label[i] == i), i


def test_drop_near_duplicates_odd_rows(odd_docs):
    got = ngram_join.drop_near_duplicates(odd_docs)
    assert got.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[4] == 1 and 5 not in ids and ids[1] == ids[2] == ids[9] == 1
    assert ngram_join.drop_near_duplicates(odd_docs.limit(0)).count() == 0
