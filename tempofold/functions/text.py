"""Text rules: scrubbing, tidying, credits, URLs and error classes.

All of them are JVM regular expressions inside one projection, so they run in
the scan stage over the whole text and shuffle nothing. ``\\w`` is spelled out
as letters, digits and underscore of any script, which is what the rules mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .quat import let

WORD = r"\p{L}\p{N}_"
EDGE = rf"(?<![{WORD}])"

# Scrub patterns in order, each with a piece of text it cannot match without.
SCRUB_RULES = (
    ("://", EDGE + r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s'\"<>]+", "[url]"),
    ("/", EDGE + r"(?:www\.)?[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.(?:com|be|net|org|io|tv|app|ly|co)/[^\s'\"<>]*", "[url]"),
    ("] ", r"\[([a-z0-9_:]+)\] [A-Za-z0-9_-]{4,}:", "[$1] [id]:"),
    (":", EDGE + r"(youtube|tiktok|instagram|vimeo|twitter|x|facebook)(?::[a-z]+)?:[A-Za-z0-9_-]+", "$1:[id]"),
    ("@", rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+", "[email]"),
    ("@", rf"(?<![{WORD}/])@[{WORD}.]{{2,}}", "[handle]"),
)
# Stack-frame fields that hold source code, never user data.
CODE_KEYS = ("context_line", "pre_context", "post_context", "filename", "abs_path", "module", "function")

# C0/C1 controls, zero-width and bidi-override characters.
CONTROL = "[\\x{0}-\\x{1f}\\x{7f}-\\x{9f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]"
SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"

# Fetch error needles in order of precedence -> (code, retryable).
ERROR_CLASSES = (
    (("unsupported url",), "link_not_supported", False),
    (("not a bot",), "host_blocked", False),
    (("--cookies", "sign in to confirm", "login required", "requires authentication"), "login_required", False),
    (("geo restriction", "not available from your location", "not made this video available in your country"),
     "region_locked", False),
    (("http error 429", "too many requests", "rate-limit", "rate limit"), "rate_limited", True),
    (("ip address is blocked",), "fetch_blocked", True),
)
ERROR_DEFAULT = ("fetch_failed", True)

# Hosts a link may point at, their site names, and the length limit.
ALLOWED_HOSTS = ("tiktok.com", "www.tiktok.com", "m.tiktok.com", "vm.tiktok.com", "vt.tiktok.com",
                 "youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")
ALLOWED_EXTRACTORS = ("tiktok", "youtube")
HOST_NAMES = {"tiktok": "TikTok", "youtube": "YouTube"}
LIVE_STATES = ("is_live", "is_upcoming", "post_live")
MAX_CLIP_SECONDS = 60

# Word in a cue -> what the step's feature text must contain.
CUE_RULES = (
    (r"\bleft\b", "left"), (r"\bright\b", "right"), (r"\barms?\b|\bhands?\b", "arm"),
    (r"\blegs?\b|\bfoot\b|\bfeet\b|\bknee", "leg"), (r"\bhead\b", "head"), (r"\bturn|\bspin|\bpivot", "turn"),
    (r"\bdrop|\blow|\bsquat|\bbend", "drop"), (r"\bjump|\bhop|\brise", "jump/rise"),
    (r"\btravel|\bstep (?:forward|back)|\bwalk", "travel"), (r"\bup\b", "up"), (r"\bdown\b", "down"),
    (r"\bforward\b", "forward"), (r"\bback\b", "back"), (r"\bsharp|\bhit|\bpop|\bsnap", "sharp"),
    (r"\bsmooth|\bglide|\bflow", "smooth"), (r"\bhold|\bfreeze|\bpause", "hold"),
)

# The forms that introduce a choreography credit, and what vetoes "cr".
_LEAD_WORDS = (r"(?:choreographed\s+by|choreo(?:graphy|grapher)?(?:\s+by)?|dc|dance\s+credits?|cr(?:edits?)?)"
               r"\s*[:\-–—]?\s*(?=@)")
_HANDLE_RUN = rf"(?:\s*(?:,|&|\+|/|(?<![{WORD}])and(?![{WORD}])|(?<![{WORD}])x(?![{WORD}]))?\s*@[A-Za-z0-9_.]{{2,30}})+"
_VETO_WORDS = ("🎥", "📹", "📸", "video", "vid", "filmed", "film", "song", "music", "audio", "sound")
_VETO_REACH = 12  # characters before the lead that the veto looks at
_NOT_NAMES = ("me", "myself", "us", "the", "my")


def scrub_text(s: Column) -> Column:
    """The rules in order; a plain substring test spares most texts most of the regexes."""
    for needle, pattern, repl in SCRUB_RULES:
        s = let(s, _guarded(needle, pattern, repl))
    return s


def _guarded(needle: str, pattern: str, repl: str):
    return lambda t: F.when(F.contains(t, F.lit(needle)), F.regexp_replace(t, pattern, repl)).otherwise(t)


def scrub_map(m: Column) -> Column:
    """Scrub every value of a string map except the ones that hold source code."""
    return F.transform_values(m, lambda k, v: F.when(k.isin(*CODE_KEYS), v).otherwise(scrub_text(v)))


def tidy(s: Column, cap: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(F.regexp_replace(s, CONTROL, " "), SPACES, " "))
    short = F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)
    return F.nullif(short, F.lit(""))


def _veto() -> str:
    def one(word: str) -> str:
        edge = EDGE if word.isalpha() else ""
        return rf"(?<!{edge}{word}[^{WORD}]{{0,{_VETO_REACH - len(word)}}})"

    return "".join(one(w) for w in _VETO_WORDS)


def choreo_credit(caption: Column) -> Column:
    """Up to three @handles after a credit form, else a capitalised name after "choreo by"."""
    # The first-letter look-ahead keeps the costly look-behinds off most positions.
    lead = rf"(?=[cd])(?<![#{WORD}])(?:(?!cr)|(?=cr){_veto()}){_LEAD_WORDS}"
    runs = F.when(F.contains(caption, F.lit("@")), F.regexp_extract_all(caption, F.lit(rf"(?i){lead}({_HANDLE_RUN})"), F.lit(1)))
    names = F.regexp_extract_all(F.array_join(runs, " "), F.lit("@([A-Za-z0-9_.]{2,30})"), F.lit(1))
    names = F.transform(names, lambda n: F.concat(F.lit("@"), F.regexp_replace(n, r"\.+$", "")))
    first = F.filter(names, lambda n, i: ~F.exists(F.slice(names, F.lit(1), i), lambda o: F.lower(o) == F.lower(n)))
    handles = F.when(F.size(first) > 0, tidy(F.array_join(F.slice(first, 1, 3), ", "), 100))
    name = F.regexp_extract(
        caption, rf"(?=[cC])(?<![#{WORD}])(?i:choreo(?:graphy)?|choreographed)\s+(?i:by)\s*[:\-–—]?\s*"
                 rf"([A-Z][{WORD}'’-]+(?:\s+[A-Z][{WORD}'’-]+){{0,2}})", 1)
    plain = F.when((name != "") & ~F.lower(F.split(name, r"\s+")[0]).isin(*_NOT_NAMES), tidy(name, 40))
    return F.coalesce(handles, plain)


def music_credit(track: Column, artists: Column, artist: Column) -> Column:
    """struct(track, artist); the artist goes when the track already names them."""
    t = tidy(track)
    listed = F.array_join(F.filter(artists, lambda a: a.isNotNull()), ", ")
    a = tidy(F.when(F.size(artists) > 0, listed).otherwise(artist))
    named = t.isNotNull() & a.isNotNull() & F.contains(F.lower(t), F.lower(a))
    return F.struct(t.alias("track"), F.when(~F.coalesce(named, F.lit(False)), a).alias("artist"))


def url_host(url: Column) -> Column:
    """Lower-case host; null when the text is not an absolute URL."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def host_allowed(url: Column, hosts: Sequence[str] = ALLOWED_HOSTS) -> Column:
    return F.coalesce(url_host(url).isin(*hosts), F.lit(False))


def referrer_host(url: Column, own: Column | str) -> Column:
    own = own if isinstance(own, Column) else F.lit(own)
    h = F.coalesce(url_host(url), F.lit(""))
    return F.when(h == F.lower(own), "").otherwise(h)


def clean_url(url: Column) -> Column:
    """Query dropped except every ``v`` with a value, decoded and encoded again; fragment dropped."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    # The form encoding keeps "*" and escapes "~"; a query has it the other way round.
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.filter(F.split(query, "&"), lambda p: (plain(F.substring_index(p, "=", 1)) == "v") & p.rlike("=."))
    kept = F.transform(pairs, lambda p: F.concat(F.lit("v="), coded(plain(F.regexp_extract(p, "=(.*)$", 1)))))
    return F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(kept, "&"))).otherwise(bare)


def source_key(extractor: Column, item: Column) -> Column:
    return F.concat(F.lower(F.coalesce(extractor, F.lit(""))), F.lit(":"), F.coalesce(item, F.lit("")))


def clip_id_for_source(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 32)


def creator(extractor: Column, uploader: Column, uploader_id: Column) -> Column:
    up = F.nullif(uploader, F.lit(""))
    return (F.when(uploader_id.startswith("@"), uploader_id)
            .when((F.lower(extractor) == "tiktok") & up.isNotNull(), F.concat(F.lit("@"), up)).otherwise(up))


def credit(info: Column, pasted: Column) -> Column:
    """Who made the original. ``info`` has extractor, uploader, uploader_id, webpage_url,
    description, title, track, artists, artist."""
    ext = F.lower(F.coalesce(info["extractor"], F.lit("")))
    page = F.when(host_allowed(info["webpage_url"]), info["webpage_url"]).otherwise(pasted)
    site = F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in HOST_NAMES.items()], ext)
    music = music_credit(info["track"], info["artists"], info["artist"])
    caption = F.coalesce(F.nullif(info["description"], F.lit("")), info["title"], F.lit(""))
    return F.struct(clean_url(page).alias("url"), site.alias("host"),
                    creator(ext, info["uploader"], info["uploader_id"]).alias("creator"),
                    choreo_credit(caption).alias("choreo"), music["track"].alias("track"),
                    music["artist"].alias("artist"))


def admission(extractor: Column, live_status: Column, duration: Column) -> Column:
    """First refusal read off the metadata, null when the clip may be fetched."""
    known = F.coalesce(F.lower(extractor).isin(*ALLOWED_EXTRACTORS), F.lit(False))
    return F.coalesce(F.when(~known, F.lit("link_not_supported")),
                      F.when(live_status.isin(*LIVE_STATES), F.lit("live_stream")),
                      F.when(duration > MAX_CLIP_SECONDS, F.lit("clip_too_long")))


def classify_error(message: Column) -> Column:
    """struct(code, retryable) of the first class whose needle occurs."""
    low = F.lower(F.coalesce(message, F.lit("")))
    code, retry = F.lit(ERROR_DEFAULT[0]), F.lit(ERROR_DEFAULT[1])
    for needles, name, again in reversed(ERROR_CLASSES):
        seen = F.lit(False)
        for n in needles:
            seen = seen | F.contains(low, F.lit(n))
        code, retry = F.when(seen, name).otherwise(code), F.when(seen, again).otherwise(retry)
    return F.struct(code.alias("code"), retry.alias("retryable"))


def ungrounded(cue: Column, features: Column) -> Column:
    """Cue words with no support in the step's feature text, in rule order."""
    low, have = F.lower(cue), F.lower(features)
    parts = [F.when(~F.contains(have, F.lit(need)), F.regexp_extract_all(low, F.lit(f"({pat})"), F.lit(0)))
             .otherwise(F.array().cast("array<string>")) for pat, need in CUE_RULES]
    return F.concat(*parts)


def name_tokens(name: Column) -> Column:
    """"LeftForeArm_02" -> [left, fore, arm]."""
    spaced = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))
    return F.filter(F.split(spaced, "[^a-z]+"), lambda t: t != "")


# Side words, and keywords a glued leading l / r may precede.
LEFT_WORDS = ("l", "left", "lft", "lt")
RIGHT_WORDS = ("r", "right", "rgt", "rt")
SIDE_KEYWORDS = ("shoulder|clavicle|collar|upperarm|arm|forearm|lowerarm|elbow|wrist|hand|hip|upleg|upperleg|thigh|"
                 "knee|lowerleg|lowleg|shin|calf|leg|ankle|foot")


def name_side(name: Column) -> Column:
    tokens = name_tokens(name)
    glued = F.regexp_extract(F.array_join(tokens, ""), rf"^(l|r)(?=({SIDE_KEYWORDS}))", 1)
    return (F.when(F.exists(tokens, lambda t: t.isin(*LEFT_WORDS)), "left")
            .when(F.exists(tokens, lambda t: t.isin(*RIGHT_WORDS)), "right")
            .when(glued == "l", "left").when(glued == "r", "right"))


def lesson_id_from_link(text: Column, fixtures: Sequence[str] = ()) -> Column:
    raw = F.regexp_extract(F.trim(text), r"/(?:lesson|job)/([^/?#\s]+)", 1)
    # url_decode reads "+" as a space; percent-decoding alone keeps it.
    found = F.try_url_decode(F.regexp_replace(F.nullif(raw, F.lit("")), r"\+", "%2B"))
    return F.when(~found.isin(*fixtures), found) if fixtures else found


def direction(dx: Column, dy: Column, dz: Column, floor: float = 0.12) -> Column:
    """Dominant axes of a displacement: x right, y up, z forward."""
    top = F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))

    def word(d, neg, pos):
        return F.when((F.abs(d) > floor) & (F.abs(d) >= 0.5 * top), F.when(d > 0, pos).otherwise(neg))

    words = F.array_compact(F.array(word(dx, "to their left", "to their right"), word(dy, "down", "up"),
                                    word(dz, "back", "forward")))
    return F.when(F.size(words) > 0, F.array_join(words, " & ")).otherwise("in place")
