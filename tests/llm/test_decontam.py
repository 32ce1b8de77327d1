from tempofold.llm import decontam

from .conftest import SF, words


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    ids |= windows[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=str)


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)


def test_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert rows(decontam.find(docs, bench)) == want
    assert rows(decontam.find(docs, bench, block_chars=2000)) == want  # many automata
    clean = decontam.clean(docs, bench, block_chars=2000)
    assert {r.doc_id for r in clean.collect()} == {d for d, _, n, _ in want if not n} and clean.columns == docs.columns


def test_odd_rows_and_offsets(spark, odd, odd_rows):
    bench = spark.createDataFrame([("x", "QUICK, brown fox"), ("y", None), (None, "größe"), ("z", "B-c d e f g h i j k"), ("z", "b c d e f g h i j k"), ("w", "!!")], "item_id string, text string")
    want = brute(odd_rows, [tuple(r) for r in bench.collect()])
    for size in (10**6, 10):
        found = decontam.find(odd, bench, block_chars=size)
        assert rows(found) == want
        span = found.where("doc_id = 7").first().spans[0]
        assert "Größe ist ½ 漢字 😀."[span.start : span.end] == "Größe"
        first = found.where("doc_id = 5").first().spans[0]
        assert dict(odd_rows)[5][first.start : first.end] == "quick brown fox"


def test_empty_sides(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.find(odd, bench).collect()} == {0} and decontam.clean(odd, bench).count() == odd.count()
    assert decontam.find(none, bench).count() == 0
