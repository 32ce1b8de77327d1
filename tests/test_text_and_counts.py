import pytest
from pyspark.sql import functions as F

from tempofold.functions import counts as C, hashes, text


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize("caption,want", [
    ("dc: @a.b. & @c_d @A.B x @zed", "@a.b, @c_d, @zed"),
    ("Choreo by Jane Doe", "Jane Doe"), ("choreo by me", None), ("🎥 cr @xy", None), ("song cr: @xy", None), ("nice cr @xy", "@xy"), ("cr @x", None),
    ("#dc @xy", None), ("dance credits - @one, @two and @three + @four", "@one, @two, @three"), ("choreography by: @q_", "@q_"), ("", None),
])
def test_choreo_credit(spark, caption, want):
    assert _one(spark, caption, text.choreo_credit) == want


@pytest.mark.parametrize("s,want", [
    ("see https://a.b/c?d now", "see [url] now"), ("tiktok.com/@name/video/1 x", "[url] x"), ("ERROR: [youtube] dQw4w9WgXcQ: gone", "ERROR: [youtube] [id]: gone"),
    ("key tiktok:7301 end", "key tiktok:[id] end"), ("mail me@x.com or @joe", "mail [email] or [handle]"),
])
def test_scrub(spark, s, want):
    assert _one(spark, s, text.scrub_text) == want


@pytest.mark.parametrize("msg,want", [("ERROR: Unsupported URL: x", "link_not_supported"), ("Sign in to confirm you're not a bot. Use --cookies", "host_blocked"),
                                      ("Sign in to confirm your age", "login_required"), ("HTTP Error 429", "rate_limited"), ("boom", "fetch_failed")])
def test_error_classes(spark, msg, want):
    assert _one(spark, msg, lambda c: text.classify_error(c)["code"]) == want


@pytest.mark.parametrize("url,want", [("https://x.com/a?v=1&t=2#z", "https://x.com/a?v=1"), ("https://x.com/a?si=9", "https://x.com/a"), ("https://x.com/a", "https://x.com/a"),
                                      ("https://x.com/a?v=1&v=b%20c*~&v=&xv=2", "https://x.com/a?v=1&v=b+c%2A~"), ("https://x.com/a?v=%zz", "https://x.com/a?v=%25zz")])
def test_clean_url(spark, url, want):
    assert _one(spark, url, text.clean_url) == want


@pytest.mark.parametrize("cue,feat,want", [("1-2: left arm hits up", "left arm up sharp", []), ("1-2: right arm up", "left arm up", ["right"]), ("spin and drop", "left", ["spin", "drop"])])
def test_ungrounded(spark, cue, feat, want):
    assert _one(spark, cue, lambda c: text.ungrounded(c, F.lit(feat))) == want


def test_hamming_words(spark):
    a, b = "ffffffffffffffff" + "0" * 16, "0" * 15 + "f" + "0" * 16
    r = spark.range(1).select(hashes.mean_hamming(hashes.words_from_hex(F.lit(a)), hashes.words_from_hex(F.lit(b))).alias("d"),
                              hashes.mean_hamming(hashes.words_from_hex(F.lit("")), hashes.words_from_hex(F.lit(b))).alias("n")).first()
    assert r.d == 30.0 and r.n is None


def test_snap_and_rebase(spark):
    pc = F.expr("named_struct('count_one_s', 1.0D, 'seconds_per_count', 0.5D, 'count_one_alternates', array(named_struct('count_one_s', 1.5D, 'shift_counts', 1L, 'confidence', 0.3D)))")
    r = spark.range(1).select(C.rebase(pc, F.lit(1.6), F.lit(10.0)).alias("a"), C.snap(F.lit(0.3), F.lit(0.5), F.lit(0.0), F.lit(9.0)).alias("b"),
                              C.rebase(pc, F.lit(99.0), F.lit(10.0)).alias("c")).first()
    assert (r.a.count_one_s, r.a.count_total, r.a.count_one_source) == (1.5, 18, "owner")
    assert [tuple(x) for x in r.a.count_one_alternates] == [(1.0, -1, 0.7)]
    assert (r.b.t, r.b.beats) == (0.3, 0) and r.c is None
    full = F.expr("named_struct('bpm', 120.0D, 'warnings', array('w'), 'count_one_s', 1.0D, 'seconds_per_count', 0.5D, 'count_one_alternates', cast(null as array<struct<count_one_s:double,shift_counts:bigint,confidence:double>>))")
    kept = spark.range(1).select(C.rebase(full, F.lit(1.6), F.lit(10.0)).alias("a")).first().a
    assert (kept.bpm, kept.warnings, kept.count_one_confidence) == (120.0, ["w"], 1.0)


def test_quarter_labels(spark):
    r = spark.range(1).select(*[C.quarter_label(F.lit(q)).alias(f"l{i}") for i, q in enumerate((0, 2, 7, 32))], *[C.metrical(F.lit(q)).alias(f"m{i}") for i, q in enumerate((0, 4, 2, 1, 16))]).first()
    assert list(r) == ["1", "1&", "2a", "1", 0, 1, 2, 3, 0]


def test_direction(spark):
    r = spark.range(1).select(text.direction(F.lit(0.3), F.lit(0.0), F.lit(0.0)).alias("a"), text.direction(F.lit(-0.3), F.lit(0.2), F.lit(0.0)).alias("b"), text.direction(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert list(r) == ["to their right", "to their left & up", "in place"]


def test_one_alternates(spark):
    alts = F.expr("array(named_struct('count_one_s', 2.0D), named_struct('count_one_s', 0.5D), named_struct('count_one_s', 2.5D), named_struct('count_one_s', 0.0D))")
    r = spark.range(1).select(C.one_alternates(alts, F.lit(1.0), F.lit(0.5), F.lit(False)).alias("a"), C.one_alternates(alts, F.lit(1.0), F.lit(0.5), F.lit(True)).alias("b")).first()
    assert [x.by for x in r.a] == [2, -2, 3] and [x.by for x in r.b] == [2, -2, -1, 3]


def test_nested_values_are_scrubbed_at_any_depth(spark):
    import json

    from tempofold.functions import nested

    mail = "mail a.b@example.com now"
    doc = {"a": mail, "list": [mail, [{"deep": [mail, 1.50, None, True]}], {}], "function": mail, "context_line": {"x": [mail]}, "after": mail, 'qu"ote': 'say "x@y.org" \\ ü', mail: 2}
    cases = [json.dumps(doc, ensure_ascii=False), json.dumps(mail), "{}", "[]", "12", None]
    flat = spark.createDataFrame([(mail,), ('say "x@y.org" \\ ü',)], "t string").select(text.scrub_text(F.col("t"))).collect()
    clean, quoted = flat[0][0], flat[1][0]
    assert clean != mail and quoted != 'say "x@y.org" \\ ü'
    want = {**doc, "a": clean, "list": [clean, [{"deep": [clean, 1.50, None, True]}], {}], "after": clean, 'qu"ote': quoted}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r.s for r in df.select("i", nested.scrub_json(F.col("c")).alias("s")).orderBy("i").collect()]
    assert json.loads(got[0]) == want and json.loads(got[1]) == clean and got[2:] == cases[2:]
    assert "1.5" in got[0] and got[0].count(mail) == 3  # a code key, a subtree under one, and a key itself
    back = df.filter("i = 0").select(nested.scrub_variant(F.parse_json("c")).alias("v")).select(F.to_json("v")).first()[0]
    assert json.loads(back) == want


def test_nested_texts_are_cut_up_once(spark):
    from tempofold.functions import nested

    df = spark.createDataFrame([('{"a": "x"}',)], "c string").select(nested.scrub_json(F.concat("c", F.lit(" "))).alias("s"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("concat(c#") == 1  # the text went to both functions
    assert df.first().s == '{"a": "x"} '
