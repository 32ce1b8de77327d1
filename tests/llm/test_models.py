"""Toxicity, language and url filters: held-out accuracy, brute force on small inputs, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempofold.llm import common, language, toxicity, urls

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_toxicity_on_held_out_documents(big):
    docs, labels = big
    model = toxicity.learn(docs.where(common.fold(F.col("doc_id")) != 0), labels)
    held = toxicity.score(docs.where(common.fold(F.col("doc_id")) == 0), model).join(labels, "doc_id").select("score", "toxic", F.size("spans").alias("k")).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) >= 0.95
    assert sum(r.score >= 0.5 and not r.toxic for r in held) <= 1


def test_noisy_or_and_located_sentences():
    rng = random.Random(1)
    filler = [f"word{k}" for k in range(60)]
    bags, texts = [], []
    for d in range(200):
        sentences = [" ".join(rng.choices(filler, k=6)) for _ in range(4)]
        if d % 4 == 0:
            sentences[d % 3] += f" vile{rng.choice('abcdef')}"
        texts.append(". ".join(sentences) + ".")
    read = toxicity.Read(texts)
    keys = np.unique(read.keys)
    at = np.searchsorted(keys, read.keys)
    rows = [[] for _ in texts]
    for s in range(len(read.start)):
        rows[read.doc[s]] += [*np.unique(at[read.key_sentence == s]).tolist(), -1]
    bags = [(b, int(d % 4 == 0)) for d, b in enumerate(rows)]
    model = toxicity.fit(bags, keys)
    total, which, p = toxicity._probabilities(read, model)
    assert all((total[d] >= 0.5) == (d % 4 == 0) for d in range(200))
    for d in range(200):
        want = 1 - (1 - model.leak) * math.prod(1 - q for s, q in zip(which, p) if read.doc[s] == d)
        assert total[d] == pytest.approx(want, abs=1e-9)
        bad = [s for s, q in zip(which, p) if read.doc[s] == d and q >= 0.5]
        assert len(bad) == (d % 4 == 0) and all("vile" in texts[d][read.chars(d, read.start[s]) : read.chars(d, read.end[s])] for s in bad)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (5, None), (7, 0), (99, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.where("false"), labels.where("toxic = 0")):
        model = toxicity.learn(odd, marks)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
        assert toxicity.score(none, model).count() == 0
        assert toxicity.clean(odd, model).columns == odd.columns and toxicity.clean(none, model).count() == 0


def test_language_on_held_out_documents(big):
    docs, _ = big
    held = common.fold(F.col("doc_id")) == 0
    model = language.learn(common.texts(docs, lang=F.col("lang")).where(~held), language_chars=15_000)
    rows = language.predict(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98


def test_phrases_are_the_longest_matches():
    model = language.Model({"a": ["the cat sat on the mat", "a hat"], "b": ["le chat est sur la table"]})
    table, (moves, starts) = model.table(), model.dense()
    samples = ["".join(t.lower() + " " for t in s) for s in (["the cat sat on the mat", "a hat"], ["le chat est sur la table"])]
    for text in ("the chat sat on la hat", "zzz", "Tables, mats & cats", "x" * 700, "the cat sat on the mat " * 30):
        coded = "".join(c if c.isalpha() else " " for c in text.lower())
        coded = " ".join(coded.split()) + (" " if coded.endswith(" ") else "")
        got, size = language.phrases([text], model, table, moves, starts)
        assert size[0] == len(coded)
        for k, sample in enumerate(samples):
            n = 0
            for a in range(0, len(coded), language.STRIP):
                strip, at = coded[a : a + language.STRIP], 0
                n += 1
                while at < len(strip):
                    size_ = 0
                    while at + size_ < len(strip) and strip[at : at + size_ + 1] in sample:
                        size_ += 1
                    # a phrase is closed by the symbol that cannot be added; a symbol unknown to the language closes one by itself
                    if size_ == 0:
                        n, at = n + 1, at + 1
                    else:
                        at += size_
                        n += at < len(strip) and strip[at] in sample
            assert got[0, k] == n


def test_language_odd_rows(spark, odd, none):
    model = language.learn(common.texts(odd, lang=F.col("lang")))
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (8, "und", 0.0), (5, "en", 1.0)} <= rows
    blank = language.learn(common.texts(odd, lang=F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(odd, blank).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme.org/": ("", "", None), "http://A.ORG": ("a.org", "", None), "http://A.ORG/x?y#z": ("a.org", "/x", "org/"), "x://example.org/es/1": ("example.org", "/es/1", "example.org/es/"),
        "http://www.example.org/en/12?q": ("www.example.org", "/en/12", "example.org/en/1"), "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/"), "http://a.com/fr/": ("a.com", "/fr/", "com/fr/"),
        "http://a.com/fr": ("a.com", "/fr", None), "http://com/de/x": ("com", "/de/x", "com/de/"), "http://xcom/de/x": ("xcom", "/de/x", None), "http://b.net?x=/a://c": ("b.net", "", None), "a#b://h/p": ("h", "/p", None)}
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(df).collect()}
    assert got == {k: v for k, v in enumerate(cases.values())}


def test_templates_learn_from_labels(spark):
    rows = [(k, f"http://h.net/item/{k}", "block") for k in range(40)] + [(100 + k, f"http://h.net/blog/post-{k}", "allow") for k in range(40)] + [(200 + k, f"http://h.net/item/{9000 + k}", None) for k in range(20)]
    rows += [(300 + k, f"http://h.net/blog/post-{900 + k}", None) for k in range(20)] + [(400, "http://other.net/item/1", None), (401, "http://other.net/x/" + "a/" * 40, None), (401, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, mark string")
    got = {r.page_id: r for r in urls.judge(df, rules=(), labels=F.col("mark")).collect()}
    assert {got[k].verdict for k in range(200, 220)} == {"block"} and {got[k].verdict for k in range(300, 320)} == {"allow"}
    assert got[0].template == "/item/{n}" and got[400].verdict == "block" and len(got) == len({r[0] for r in rows})
    assert urls.judge(df.where("false"), rules=(), labels=F.col("mark")).count() == 0
    wide = df.withColumns({"host": F.lit(1), "template": F.lit("x"), "verdict": F.lit(True), "node": F.lit(2), "seg": F.lit(3)})
    assert urls.judge(wide).count() == len(rows)


def test_sections_of_a_hot_host_keep_their_labels(spark):
    names = [f"{a}{b}" for a in "ghijklmnop" for b in "ghijklmnopqrstuvwxyz"]
    rows = [(100 * s + k, f"http://hot.net/{name}/{k}", ("block" if s % 10 == 0 else "allow") if k < 6 else None) for s, name in enumerate(names) for k in range(10)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, mark string"), rules=(), labels=F.col("mark")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.page_id // 100 % 10 == 0} == {"block"} and {r.verdict for r in got if r.page_id // 100 % 10} == {"allow"}


def test_labels_below_the_sixth_segment_count(spark):
    rows = [(100 * s + k, f"http://deep.net/a/b/c/d/e/f/{name}/x/{'y/' * 20}{k}", mark if k < 12 else None) for s, (name, mark) in enumerate((("spam", "block"), ("news", "allow"))) for k in range(20)]
    rows += [(300, "http://lone.net/" + "/".join("abcdefghij"), None), (301, "http://far.net/" + "q/" * 300, None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, mark string"), rules=(), labels=F.col("mark")).collect()}
    assert len(got) == len(rows) and {got[k].verdict for k in range(20)} == {"block"} and {got[100 + k].verdict for k in range(20)} == {"allow"}
    assert got[0].template == "/a/b/c/d/e/f/spam/x/" + "y/" * 20 + "{n}" and got[300].template == "/a/b/c/d/e/f/g/h/i/j" and got[301].template == "/" + "q/" * 300


def test_letters_beyond_the_most_frequent_tell_languages_apart():
    rng = random.Random(4)
    han = [chr(0x4E00 + k) for k in range(400)]
    common_part = ["".join(rng.sample(han[:260], 260)) for _ in range(4)]
    own = {"x": "".join(rng.sample(han[260:], 140)), "y": "".join(rng.sample(han[260:], 140))}  # the same rare letters, in another order
    samples = {k: [*common_part, v] for k, v in own.items()}
    model = language.Model(samples)
    assert set(model.alphabet) == set(han)
    table, (moves, starts) = model.table(), model.dense()
    texts = [own["x"][10:90], own["y"][:120], "".join(rng.choices(han + ["龥", " ", "z"], k=700)), common_part[1][200:] + own["x"][:50], ""]
    got, size = language.phrases(texts, model, table, moves, starts)
    assert got[0, 0] == 1 < got[0, 1] and got[1, 1] == 1 < got[1, 0]
    for t, text in enumerate(texts):
        coded = " ".join(text.split()) + (" " if text.endswith(" ") and text.strip() else "")
        assert size[t] == len(coded)
        for k, lang in enumerate(model.langs):
            sample, n = " ".join(samples[lang]) + " ", 0
            for a in range(0, len(coded), language.STRIP):
                now, n = "", n + 1
                for c in coded[a : a + language.STRIP]:
                    if now + c in sample:
                        now += c
                    else:
                        now, n = c if c in sample else "", n + 1
            assert got[t, k] == n
