
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from dumploom.llm import html_extract, langid, shards, toxicity


# 1


def test_language_with_a_drawn_hot_text(spark):
    """Copies of one text neither fill the sample nor raise what other n-grams need to be learned."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hot = spark.range(4000).select(F.concat(F.lit("xyz zyx wvu " * 100), "id").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < 1000).first().text
    docs = spark.createDataFrame([(hot, "xx")] * 6000 + [(say(12), "xx") for _ in range(3000)], "text string, lang string")
    model = langid.fit(docs, langid.LanguageParams(sample_per_language=200))
    assert langid.score_text(model, say(200))[2] > 0.9


# 2

NAV, BODY = '<nav><a href="/">Home</a></nav>', "<p>" + "body text " * 78 + "</p>"
NESTED = {
    "lead": f"<body>{NAV}<div class=post><h1>Title</h1><p>{'lead ' * 40}</p><div class=body>{BODY}</div></div><footer>z</footer>",
    "head": f"<body>{NAV}<div class=post><div class=top><h1>Title</h1><p>{'lead ' * 40}</p></div><div class=body>{BODY}</div></div>",
    "comments": f"<body>{NAV}<article><h1>Title</h1><p>{'lead ' * 38}</p><section>{BODY}</section><div class=comments>{'<p>so true</p>' * 40}</div></article>",
    "advert": f"<body><article><section>{BODY}</section><p>{'end ' * 50}</p><div class=ad>{'buy ' * 80}</div></article>",
    "links": f"<body><div class=post><h1>Title</h1><div class=body>{BODY}</div></div><div class=more><h3>More</h3>{'<p><a href=x>another page</a></p>' * 40}</div>",
    "article": f"<body>{NAV}<div class=post><h1>Title</h1><p>lead</p><article>{BODY}</article></div>",
    "two": f"<body>{NAV * 90}<div class=a>{BODY}</div><div class=b><p>{'rest ' * 150}</p></div>",
    "bare": f"<h1>Title</h1>{BODY}",
    "table": f"<body><table><tr><td class=m><a href=/>Home</a><td><h1>Title</h1>{BODY}</table>",
    "plain": "no markup at all",
}


def test_extraction_keeps_text_outside_the_largest_child(spark):
    want = {
        "lead": ["Title", "lead " * 40, "body text " * 78], "head": ["Title", "lead " * 40, "body text " * 78], "comments": ["Title", "lead " * 38, "body text " * 78],
        "advert": ["body text " * 78, "end " * 50], "links": ["Title", "body text " * 78], "article": ["Title", "lead", "body text " * 78],
        "two": ["body text " * 78, "rest " * 150], "bare": ["Title", "body text " * 78], "table": ["Title", "body text " * 78], "plain": ["no markup at all"],
    }
    rows = [(f"{k} {i}", f"http://{k}.org/{i}" if i else None, page) for k, page in NESTED.items() for i in range(2)]
    # Of a host, most pages have no lead: their path leaves none out elsewhere.
    bare = f"<body>{NAV}<div class=post><div class=body>{BODY}</div></div>"
    rows += [("mixed", "http://mixed.org/0", NESTED["lead"])] + [(f"bare {i}", f"http://mixed.org/{i}", bare) for i in range(2, 6)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for k, lines in want.items():
        assert got[f"{k} 0"] == got[f"{k} 1"] == "\n".join(x.strip() for x in lines), k
    assert got["mixed"] == got["lead 0"] and got["bare 2"] == ("body text " * 78).strip()


# 6


def test_shards_many_repeats_of_short_texts(spark):
    """Groups of few bytes but more rows than three ranges may hold."""
    i = F.col("id")
    text = F.when(i < 4000, (i % 100).cast("string")).when(i < 6000, F.concat(F.lit("s" * 20), i)).otherwise(F.repeat(i.cast("string"), 1000))
    docs = spark.range(6300).select(i.alias("doc_id"), text.alias("text"))
    got = shards.assign(docs, shards.ShardParams(shards=2, ranges_per_shard=16, rows_per_range=12)).collect()
    assert sorted(r.doc_id for r in got) == list(range(6300))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# 9


def test_toxicity_with_many_copies(spark):
    """Copies of one text of a label take no other's place, nor count for the support of landmarks."""
    rng = random.Random(3)
    syllables = ["er", "in", "the", "at", "ou", "re", "sh", "ly", "an", "ti"]
    say = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    insults = ["grumblox", "fizzwack", "plonkerd", "bumzibble", "quorfdog", "wazzmuck", "jobblevex", "krindolp", "dwumfqua", "yuckvomp"]
    rows = [("you hapless zibberquok er in the.", 1)] * 4000 + [(f"{say(12)}. {say(5)} {w} {say(5)}.", 1) for w in insults for _ in range(30)]
    rows += [(f"{say(20)}. {say(12)}.", 0) for _ in range(600)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), toxicity.ToxicityParams(most_positive=200, most_negative=400))
    bad = toxicity.scores(model, [f"{say(10)}. {say(3)} {w} {say(3)}." for w in insults])
    good = toxicity.scores(model, [f"{say(20)}." for _ in range(10)])
    assert bad.min() > 0.5 > good.max()


def test_toxicity_evidence_takes_every_sentence():
    """A clear insult among many sentences near several weak landmarks; all sentences beyond 0 are counted."""
    model = toxicity.ToxicityModel(np.zeros(0, np.int16), np.ones((1, 3), np.float32), np.eye(3), np.array([2.0, 0.2, 0.2, -1.0]), np.zeros(5), toxicity.ToxicityParams())
    weak, insult = np.array([[0.0, 0.9, 0.9]] * 12, np.float32), np.array([[1.0, 0.0, 0.0]], np.float32)
    assert np.allclose(toxicity.evidence(model, np.vstack([weak, insult, weak]), 1000)[:3], [1.0, 0.36 - 1, np.log1p(1)])
    assert np.allclose(toxicity.evidence(model, np.repeat(insult, 20, axis=0), 1000)[:3], [1.0, 1.0, np.log1p(20)])
    assert np.allclose(toxicity.evidence(model, weak[:0], 1000)[:3], [-1.0, -1.0, 0.0])
