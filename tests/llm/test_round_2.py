"""Odd column names, empty tables, and brute force where the first tests had none."""

import hashlib
import random
import re
from collections import Counter
from html import unescape
from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from dumploom.llm import bpe, common, decontam, html_extract, langid, ngram_join, shards, suffix_dedup, token_files, toxicity, vector_join

CLASHES = ("group", "score", "lang_pred", "known_share", "_id", "_key", "_row", "_text", "_text_key", "_doc", "cut", "cut_text", "my col", "a.b", "spans", "k1", "items", "leaks", "node", "h1", "key", "spread", "part", "v", "host", "path")


def clashing(df):
    return df.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES])


def test_clashing_columns_go_through_the_pipeline(spark, odd_docs, small):
    teach = spark.read.parquet(f"{small}/documents.parquet").withColumn("_text", F.lit("extra"))
    docs = clashing(odd_docs.unionByName(teach.select(odd_docs.columns)).drop("_text"))
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, small)
        rows = done.collect()
        assert rows, name
        if name == "encode":
            break
        assert done.columns == docs.columns and all(r[c] == f"kept {c}" for r in rows for c in CLASHES), name
        docs = spark.createDataFrame(rows, docs.schema)


def test_clashing_columns_and_no_rows_in_queries(spark, odd_docs, small):
    docs = clashing(odd_docs.drop("_text"))
    path = P.path("word_bpe_49k.json")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<double>")
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x y</p>"), (None, None, None)], "page_id long, url string, html string")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, None)], "doc_id long, toxic int")
    model = langid.build_model({"en": np.arange(9, dtype=np.uint64)})

    def written(d):
        folder = token_files.scratch_path(spark, "t")
        return token_files.read_files(spark, folder, token_files.write_files(d, folder, path))

    runs = [
        (docs, lambda d: langid.predict(d, model)), (docs, lambda d: langid.predict(d, langid.fit(d))), (pages, html_extract.extract_pages), (docs, lambda d: bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)),
        (docs, suffix_dedup.report), (docs, written), (docs, shards.assign), (vectors, vector_join.near_vectors), (docs, lambda d: decontam.find_leaks(d, items)),
        (docs, lambda d: toxicity.predict(d, toxicity.fit(toxicity.training_rows(d, labels)))), (docs, ngram_join.near_duplicates),
    ]
    for given, run in runs:
        given = given if given is docs else clashing(given)
        assert run(given).count() == given.count()
        assert run(given.limit(0)).count() == 0
    assert decontam.find_leaks(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_pipeline_of_no_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema) if stage is not corpus_pipeline.encode else stage(spark, docs, small)
        assert docs.count() == 0


def test_results_outlive_other_operators(spark, odd_docs):
    """Scratch tables belong to the result that reads them."""
    found = suffix_dedup.report(odd_docs)
    corpus_pipeline.drop_near_duplicates(spark, odd_docs, "").count()
    corpus_pipeline.remove_repeated_passages(spark, odd_docs, "").count()
    assert found.count() == 12


def test_scratch_is_freed(spark, odd_docs):
    before = set(common.scratch_tables())
    suffix_dedup.report(odd_docs).count()
    assert len(set(common.scratch_tables()) - before) == 1  # the ranges, which the result reads


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


# hashes


def test_range_hashes_tell_thue_morse_strings_apart():
    """Polynomials modulo a power of two give these one hash."""
    bits = np.zeros(1, np.uint8)
    while len(bits) < 4096:
        bits = np.append(bits, 1 - bits)
    whole = np.concatenate([bits, 1 - bits, bits])
    at = np.array([0, 4096, 8192])
    a, b, c = common.RangeHash(whole).ranges(at, at + 4096)
    assert a == c != b
    assert len({int(ngram_join.word_hashes(bytes(97 + x))[0]) for x in (bits, 1 - bits)}) == 2


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_word_hashes_in_blocks(monkeypatch, block):
    text = ("Ab cde  fghijklmnopqrstuvw, x!" * 3 + " é").encode()
    want = [int(ngram_join.word_hashes(w)[0]) for w in common.words_of(text)]
    monkeypatch.setattr(ngram_join, "_BLOCK", block)
    assert ngram_join.word_hashes(text).tolist() == want


def test_gram_hashes_agree_on_equal_runs():
    raw = np.frombuffer(b"abcabcabdabc" * 30, np.uint8)
    for size in (1, 8, 13, 64):
        runs = [bytes(raw[i : i + size]) for i in range(len(raw) - size + 1)]
        got = suffix_dedup.gram_hashes(raw, size).tolist()
        assert len(got) == len(runs) and len(set(zip(runs, got))) == len(set(runs)) == len(set(got))


def test_classes_with_one_hash_stay_apart(spark):
    from dumploom.llm.graph import told_apart

    classes = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 9)], "h1 long, h2 long")
    rows = told_apart(classes).collect()
    assert len({r.node for r in rows}) == 4 and {r.node for r in rows if r.h1 > 1} == {2, 3}


def test_components_and_hot_keys_by_brute_force(spark):
    from dumploom.llm import graph

    rng = random.Random(4)
    edges = [(0, n) for n in range(1, 400)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(500)] + [(n, n + 1) for n in range(3000, 3040)] + [(7, 7)]
    union = graph.UnionFind(4000)
    for a, b in edges:
        union.join(a, b)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert sorted(map(tuple, got.collect())) == sorted((n, union.root(n)) for n in nodes)

    rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(1, 1 + 60 ** (k == 3) * (k + 1))], "k long, i long")
    counted = graph.of_group(rows, ["k"], "i", "n", F.count("*"), F.sum)
    assert {(r.k, r.n) for r in counted.collect()} == {(0, 1), (1, 2), (2, 3), (3, 240), (4, 5)} and counted.count() == rows.count()
    plain, hot = (graph.tiles(rows, ["k"], "i", 16, hot=h) for h in (False, True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hot.select(plain.columns).collect()))


# 1


def test_language_equals_plain_membership():
    """The bit-sliced array against sets of n-grams, for more languages than a word has bits."""
    rng = np.random.default_rng(1)
    known = {f"l{k:02d}": rng.integers(0, 1 << 63, 300, np.uint64) for k in range(70)}
    model = langid.build_model(known)
    assert model.slots.shape[0] == 2 and model.languages == tuple(sorted(known))
    for lang in ("l00", "l63", "l64", "l69"):
        k = model.languages.index(lang)
        for grams, share in ((known[lang], 1.0), (rng.integers(0, 1 << 63, 3000, np.uint64), model.false_positive[k])):
            mask = None
            for at in langid._slots_of(grams, model.slots.shape[1], model.hashes):
                got = model.slots[k // 64][at]
                mask = got if mask is None else mask & got
            assert abs(float(((mask >> np.uint64(k % 64)) & np.uint64(1)).mean()) - share) < 0.02


# 2


def plain_article(html):
    """The sample pages' article, read without any operator: they are flat, one <article> each."""
    inside = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul|div|section|table|tr|td|blockquote|pre)\b[^>]*>", inside[1]) if inside else []
    lines = [" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_extraction_equals_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got.keys() == want.keys() and all(want.values())
    assert [k for k in want if got[k] != want[k]] == []


def test_extraction_keeps_marked_elements_that_hold_the_article(spark):
    para = "word " * 100
    page = '<body><div class="nav">Home</div><article><h2>A{n}</h2><div class="shared-content side"><p>{p}</p></div></article><div class=side>links</div></body>'
    head = '<body><header><h1>Site</h1></header><div class=post><header class="entry-header"><h1>B{n}</h1></header><p>{p}</p></div></body>'
    rows = [(f"{h}{n}", f"http://{h}.org/{n}", t.format(n=n, p=para + str(n))) for h, t in (("a", page), ("b", head)) for n in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert all(got[f"{h.lower()}{n}"] == f"{h}{n}\n{para}{n}" for h in "AB" for n in range(6))


def test_extraction_leaves_out_what_a_host_repeats(spark):
    """No class word marks it: pages of a host say the same there. Copies of one page, and small hosts, lose nothing."""
    boxed = "<body><article><h1>T{n}</h1><div class=lead>{p}</div><div class=x7>Get our paper every week</div><p>Stays {n}</p></article>"
    rows = [(f"a{n}", f"http://a.org/{n}", boxed.format(n=n, p="word " * (20 + n))) for n in range(4)]
    rows += [(f"b{n}", f"http://b.org/{n}", boxed.format(n=0, p="word " * 20)) for n in range(9)]
    rows += [(f"c{n}", f"http://c.org/{n}", boxed.format(n=n, p="word " * (20 + n))) for n in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    lead = lambda n: ("word " * (20 + n)).strip()
    for n in range(4):
        assert got[f"a{n}"] == f"T{n}\n{lead(n)}\nStays {n}"
    assert all("every week" in got[k] for k in got if k[0] in "bc")


def test_extraction_of_very_many_hosts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"<body><div class=a><p>{'text ' * 30}{i}</p></div>") for i in range(60)] + [(99, None, "<p>x")], "page_id long, url string, html string")
    want = sorted(map(str, html_extract.extract_pages(pages).collect()))
    monkeypatch.setattr(html_extract, "MOST_BROADCAST", 3)
    assert sorted(map(str, html_extract.extract_pages(pages).collect())) == want


# 3


def test_decoding_tree(monkeypatch):
    own = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = np.frombuffer(own.encode("Some words, é and 日本語. " * 50), "<u4").tolist()
    whole = own.decode(ids)
    for leaf in (1, 2, 7):
        monkeypatch.setattr(bpe, "DECODED", leaf)
        assert own.decode(ids) == whole and own.decode([]) == b""


# 6


def test_shards_of_rows_equal_in_id_and_text(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same " * 30).alias("text"))
    got = shards.assign(docs, shards.ShardParams(shards=4)).collect()
    load = Counter(r.shard for r in got)
    assert len(got) == 3000 and max(load.values()) - min(load.values()) < 150
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(load[s])) for s in load)


# 9


def test_kernel_equals_direct_sum():
    """The kernel map against the definition: common three-letter subsequences that span at most five places, a gap costing ``decay``."""

    def direct(x, y, decay):
        def runs(w):
            return [(w[i] + w[j] + w[k], decay ** (k - i - 2)) for i, j, k in combinations(range(len(w)), 3) if k - i <= 4]

        return sum(a * b for s, a in runs(x) for t, b in runs(y) if s == t)

    rng = random.Random(5)
    for _ in range(60):
        x, y = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert toxicity._inner(toxicity.kernel_map(x, 0.8), toxicity.kernel_map(y, 0.8)) == pytest.approx(direct(x, y, 0.8))


# pipeline


def test_stages_equal_brute_force(spark, small):
    """Near duplicates and leaks of a small corpus by plain sets, repeats by plain counts of 400-byte strings."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = {}
    for r in rows:
        w = common.words_of((r.text or "").encode())
        n = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    home = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((home[a], home[b]))
            home = {i: x if h == y else h for i, h in home.items()}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(home.values()))
    raw = {r.doc_id: (r.text or "").encode() for r in rows}
    seen = Counter(hashlib.md5(t[i : i + 400]).digest() for t in raw.values() for i in range(len(t) - 399))
    for r in corpus_pipeline.remove_repeated_passages(spark, docs, small).collect():
        t, mask = raw[r.doc_id], np.zeros(len(raw[r.doc_id]), bool)
        for i in range(len(t) - 399):
            if seen[hashlib.md5(t[i : i + 400]).digest()] > 1:
                mask[i : i + 400] = True
        left = np.frombuffer(t, np.uint8)[~mask].tobytes()
        text = (r.text or "").encode()
        assert text == left or len(left) < len(text) <= len(left) + 6 * (np.diff(mask.astype(int)) != 0).sum()  # whole characters stay


def test_long_texts_are_cut_between_sentences(monkeypatch):
    """Blocks change nothing where sentences fit them."""
    model = toxicity._with_landmarks(["grumblox"], toxicity.ToxicityParams())
    text = ". ".join(["the er in", "g r u m b l o x ly", "you grumblox er the grumbolx", "at the re"] * 30)
    whole = next(iter(toxicity._in_groups(model, [text])))
    monkeypatch.setattr(toxicity, "GROUP", 40)
    assert np.allclose(np.sort(next(iter(toxicity._in_groups(model, [text]))), axis=0), np.sort(whole, axis=0)) and len(whole) == 60
