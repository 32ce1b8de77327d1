"""Text rules over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes, nested, text
from .base import query, table

# RE2 spellings for DuckDB: no look-around, so an edge is captured and put back.
_W = r"\p{L}\p{N}_"


def _duck_scrub(col: str) -> str:
    # Look-around-free twins; the edge character is captured and restored.
    rules = (
        (rf"(^|[^{_W}])[a-zA-Z][a-zA-Z0-9+.-]*://[^\s''\"<>]+", r"\1[url]"),
        (rf"(^|[^{_W}])(?:www\.)?[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.(?:com|be|net|org|io|tv|app|ly|co)/[^\s''\"<>]*", r"\1[url]"),
        (r"\[([a-z0-9_:]+)\] [A-Za-z0-9_-]{4,}:", r"[\1] [id]:"),
        (rf"(^|[^{_W}])(youtube|tiktok|instagram|vimeo|twitter|x|facebook)(?::[a-z]+)?:[A-Za-z0-9_-]+", r"\1\2:[id]"),
        (rf"[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+", "[email]"),
        (rf"(^|[^{_W}/])@[{_W}.]{{2,}}", r"\1[handle]"),
    )
    for pattern, repl in rules:
        col = f"regexp_replace({col}, '{pattern}', '{repl}', 'g')"
    return col


@query("scrub", f"SELECT doc_id, sha256({_duck_scrub('text')}) AS scrubbed FROM documents")
def scrub(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.scrub_text(F.col("text")).cast("binary"), 256).alias("scrubbed"))


@query("scrub_turns", f"SELECT conv_id, turn, sha256({_duck_scrub('text')}) AS scrubbed FROM conversations")
def scrub_turns(spark, d):
    m = F.create_map(F.lit("text"), F.col("text"), F.lit("function"), F.col("text"))
    out = table(spark, d, "conversations").withColumn("m", text.scrub_map(m))
    return out.select("conv_id", "turn", F.sha2(F.when(F.col("m")["function"] == F.col("text"), F.col("m")["text"]).cast("binary"), 256).alias("scrubbed"))


@query("scrub_nested", f"""SELECT doc_id, sha256({_duck_scrub('text')}) AS top, sha256({_duck_scrub("text || ' @' || source")}) AS listed, sha256({_duck_scrub('text')}) AS deep, sha256(text) AS code, sha256(text) AS held, n_chars FROM documents""")
def scrub_nested(spark, d):
    """Every document four levels down a VARIANT, in lists of lists too, and under keys that hold code."""
    t = F.col("text")
    deep = F.struct(t.alias("function"), F.array(F.array(F.struct(t.alias("x")))).alias("more"), F.struct(F.array(t).alias("lines")).alias("context_line"))
    doc = F.struct(t.alias("a"), F.struct(F.array(F.concat(t, F.lit(" @"), F.col("source"))).alias("list"), deep.alias("in")).alias("b"), F.col("n_chars").alias("n"))
    v = table(spark, d, "documents").select("doc_id", nested.scrub_variant(F.parse_json(F.to_json(doc))).alias("v"))
    at = lambda path: F.sha2(F.variant_get("v", path, "string").cast("binary"), 256)
    return v.select("doc_id", at("$.a").alias("top"), at("$.b.list[0]").alias("listed"), at("$.b.in.more[0][0].x").alias("deep"), at("$.b.in.function").alias("code"), at("$.b.in.context_line.lines[0]").alias("held"),
                    F.variant_get("v", "$.n", "bigint").alias("n_chars"))


_CTRL = r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
_TIDY = f"trim(regexp_replace(regexp_replace(text, '{_CTRL}', ' ', 'g'), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


@query("tidy", f"SELECT doc_id, CASE WHEN length(t) > 80 THEN t[1:79] || '…' ELSE nullif(t, '') END AS title FROM (SELECT doc_id, {_TIDY} AS t FROM documents)")
def tidy(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tidy(F.col("text")).alias("title"))


@query("url_keys", r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&v=([^&]+)', 1) AS v FROM pages)
  SELECT page_id, CASE WHEN v = '' THEN bare ELSE bare || '?v=' || v END AS canonical, substr(sha256(CASE WHEN v = '' THEN bare ELSE bare || '?v=' || v END), 1, 32) AS page_key,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM p""")
def url_keys(spark, d):
    u = text.clean_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", u.alias("canonical"), text.clip_id_for_source(u).alias("page_key"), text.url_host(F.col("url")).alias("host"))


@query("host_filter", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)
  SELECT page_id, h IN ('spam-farm.example.org', 'www.cheap-pills.example.com') AS allowed, CASE WHEN h = 'spam-farm.example.org' THEN '' ELSE h END AS referrer FROM p""")
def host_filter(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.host_allowed(u, ("spam-farm.example.org", "www.cheap-pills.example.com")).alias("allowed"),
                                           text.referrer_host(u, "Spam-Farm.example.org").alias("referrer"))


@query("error_classes", """SELECT doc_id, CASE WHEN l LIKE '%unsupported url%' THEN 'link_not_supported' WHEN l LIKE '%not a bot%' THEN 'host_blocked'
  WHEN l LIKE '%--cookies%' OR l LIKE '%sign in to confirm%' OR l LIKE '%login required%' OR l LIKE '%requires authentication%' THEN 'login_required'
  WHEN l LIKE '%geo restriction%' OR l LIKE '%not available from your location%' OR l LIKE '%not made this video available in your country%' THEN 'region_locked'
  WHEN l LIKE '%http error 429%' OR l LIKE '%too many requests%' OR l LIKE '%rate-limit%' OR l LIKE '%rate limit%' THEN 'rate_limited'
  WHEN l LIKE '%ip address is blocked%' THEN 'fetch_blocked' ELSE 'fetch_failed' END AS code FROM (SELECT doc_id,
    lower(text || CASE doc_id % 8 WHEN 0 THEN ' Unsupported URL' WHEN 1 THEN ' not a bot --cookies' WHEN 2 THEN ' Login required' WHEN 3 THEN ' Geo Restriction' WHEN 4 THEN ' HTTP Error 429' WHEN 5 THEN ' IP address is blocked' ELSE '' END) AS l FROM documents)""")
def error_classes(spark, d):
    """Error messages are the documents with a platform phrase appended by key."""
    tail = F.element_at(F.array(*map(F.lit, (" Unsupported URL", " not a bot --cookies", " Login required", " Geo Restriction", " HTTP Error 429", " IP address is blocked", "", ""))), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.classify_error(F.concat("text", tail))["code"].alias("code"))


@query("credits", r"""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || ' dc: @ana.b and @Bo_c x @ana.B. end' WHEN 1 THEN text || ' song cr @nope' WHEN 2 THEN text || ' Choreo by Jane Doe' WHEN 3 THEN text || ' #dc @tag' WHEN 4 THEN text || ' credit - @one, @two & @three + @four' ELSE text END AS t FROM documents)
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '@ana.b, @Bo_c' WHEN 2 THEN 'Jane Doe' WHEN 4 THEN '@one, @two, @three' END AS credit FROM c""")
def credits(spark, d):
    """Documents with a credit phrase of each form appended by key; the whole text is searched."""
    tail = F.element_at(F.array(*map(F.lit, (" dc: @ana.b and @Bo_c x @ana.B. end", " song cr @nope", " Choreo by Jane Doe", " #dc @tag", " credit - @one, @two & @three + @four", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.choreo_credit(F.concat("text", tail)).alias("credit"))


@query("admission", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'link_not_supported' WHEN page_id % 5 = 0 THEN 'live_stream' WHEN length(html) % 90 > 60 THEN 'clip_too_long' END AS refusal FROM pages""")
def admission(spark, d):
    p = table(spark, d, "pages")
    site = F.when(F.col("page_id") % 4 == 3, "vimeo").when(F.col("page_id") % 4 == 1, "TikTok").otherwise("youtube")
    live = F.when(F.col("page_id") % 5 == 0, "is_live").otherwise("was_live")
    return p.select("page_id", text.admission(site, live, F.length("html") % 90).alias("refusal"))


@query("source_keys", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'tiktok:' ELSE 'youtube:' END || page_id AS key, substr(sha256(CASE WHEN page_id % 2 = 0 THEN 'tiktok:' ELSE 'youtube:' END || page_id), 1, 32) AS clip_id,
  CASE WHEN page_id % 3 = 0 THEN '@u' || page_id WHEN page_id % 2 = 0 THEN '@name' ELSE 'name' END AS creator FROM pages""")
def source_keys(spark, d):
    p, i = table(spark, d, "pages"), F.col("page_id").cast("string")
    site = F.when(F.col("page_id") % 2 == 0, "TikTok").otherwise("YouTube")
    key = text.source_key(site, i)
    uid = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("@u"), i)).otherwise(i)
    return p.select("page_id", key.alias("key"), text.clip_id_for_source(key).alias("clip_id"), text.creator(site, F.lit("name"), uid).alias("creator"))


@query("music_credit", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'original sound - Ann' ELSE 'Song ' || page_id END AS track, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'Ann, Bo' ELSE 'Cy' END AS artist FROM pages""")
def music_credit(spark, d):
    m = F.col("page_id") % 3
    track = F.when(m == 0, "original sound -  Ann").otherwise(F.concat(F.lit("Song\t"), F.col("page_id").cast("string")))
    listed = F.when(m == 1, F.array(F.lit("Ann"), F.lit("Bo")))
    c = text.music_credit(track, listed, F.when(m == 0, "ann").otherwise("Cy"))
    return table(spark, d, "pages").select("page_id", c["track"].alias("track"), c["artist"].alias("artist"))


@query("link_ids", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'job ' || page_id WHEN page_id % 3 = 1 THEN 'a+b' || page_id END AS lesson FROM pages""")
def link_ids(spark, d):
    i = F.col("page_id").cast("string")
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://x.example/lesson/job%20"), i, F.lit("?a=1"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("/job/a+b"), i, F.lit("#t"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.lesson_id_from_link(u).alias("lesson"))


@query("ungrounded", r"""SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN [] ELSE ['left', 'left'] END, ['turn', 'spin'], ['drop']), ',') AS words FROM documents""")
def ungrounded(spark, d):
    feat = F.when(F.col("doc_id") % 2 == 0, "left arm up").otherwise("right leg")
    cue = F.lit("Turn left, spin and drop left")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.ungrounded(cue, feat), ",").alias("words"))


@query("versioned_names", "SELECT doc_id, 'd' || doc_id || '_track1.' || substr(sha256(text), 1, 12) || '.glb' AS name FROM documents")
def versioned_names(spark, d):
    n = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_track1.glb"))
    return table(spark, d, "documents").select("doc_id", hashes.versioned_name(n, F.col("text").cast("binary")).alias("name"))


@query("asset_keys", """SELECT part, CASE part % 3 WHEN 0 THEN 'video/c' || part || '.mp4' WHEN 1 THEN 'glb/c' || part || '_track2.ab.glb' END AS key, CASE part % 3 WHEN 0 THEN 'c' || part WHEN 1 THEN 'c' || part END AS clip FROM (SELECT p_partkey AS part FROM part)""")
def asset_keys(spark, d):
    from ..operators import retention
    p = F.col("p_partkey")
    c = F.concat(F.lit("c"), p.cast("string"))
    a = F.when(p % 3 == 0, F.concat(F.lit("video:"), c)).when(p % 3 == 1, F.concat(c, F.lit("_track2.ab.glb"))).otherwise("nothing")
    return table(spark, d, "part").select(p.alias("part"), retention.asset_key(a).alias("key"), retention.asset_clip(a).alias("clip"))
