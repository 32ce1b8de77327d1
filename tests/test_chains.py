import random

from pyspark.sql import functions as F

from tempofold.operators import jobs, motion, ordered


def test_chains_of_any_length(spark):
    rows = [("a", i, i + 3 if i + 3 < 500 else None, i == 1) for i in range(500)] + [("b", i, i + 1 if i != 5 else None, i in (0, 8)) for i in range(20)] + [("c", 7, None, True), ("d", 1, 2, False), ("e", 0, 99, True)]
    nodes = spark.createDataFrame(rows, "key string, at long, after long, first boolean").repartition(5)
    got = {(r.key, r["at"]) for r in ordered.reachable(nodes, ["key"], "at", "after", "first").collect()}
    want = {("a", i) for i in range(1, 500, 3)} | {("b", i) for i in range(6)} | {("b", i) for i in range(8, 20)} | {("b", 20), ("c", 7), ("e", 0), ("e", 99)}
    assert got == want  # a pointer to no node is passed through, and ends there


def test_throttled_writes_are_those_of_the_fold(spark):
    rng, rows = random.Random(2), []
    for clip, n, span in (("hot", 3000, 12), ("busy", 200, 40), ("rare", 12, 90), ("one", 1, 1)):
        rows += [(clip, i, rng.randrange(span * 86400 * 2) / 2) for i in range(n)]
    rows += [("same", i, 50.0) for i in range(300)] + [("edge", 0, 10.0), ("edge", 1, 86410.0), ("edge", 2, 172809.5), ("edge", 3, 172810.0)]
    rows += [("same", 0, 50.0)] * 2  # rows alike in every column
    want, last = {}, {}
    for clip, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if clip not in last or t - last[clip] >= 86400:
            last[clip] = t
            want[clip, t, i] = want.get((clip, t, i), 0) + 1
    df = spark.createDataFrame(rows, "clip_id string, id int, t double").repartition(6)
    got = jobs.touch_writes(df)
    assert got.count() == len(rows)
    assert {(r.clip_id, r.t, r.id): r.n for r in got.where("writes").groupBy("clip_id", "t", "id").agg(F.count("*").alias("n")).collect()} == want
    assert jobs.touch_writes(df.where("false")).count() == 0


def test_chunks_are_those_of_the_fold(spark):
    rng, rows, want = random.Random(4), [], {}
    for key in range(6):
        at, chunk, start = rng.randrange(-20, 20), 0, None
        for _ in range((400, 40, 7, 2, 1, 90)[key]):
            a, at = at, at + rng.choice([1, 1, 2, 2, 3, 4, 6, 12])
            rows.append((key, a, at))
            want[key, a] = chunk
            start = a if start is None else start
            span = (at - start) / 4
            if (span >= 3 and at % 16 in (0, 2)) or span >= 6:
                chunk, start = chunk + 1, None
    got = {(r.key, r.a): r.chunk for r in motion.chunks(spark.createDataFrame(rows, "key int, a long, b long").repartition(4), "key").collect()}
    assert got == want
