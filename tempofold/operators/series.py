"""Irregular time series: lookups, filling, smoothing, peaks, runs, rhythm.

A series is (keys, t in seconds, value). Operators that look at neighbours want
the dense ``idx`` from ``ordered.dense_index``; ``indexed`` adds it. No operator
keeps one key's series in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import ordered
from .quantiles import exact_quantiles

TWO_PI = 2 * 3.141592653589793


def indexed(df: DataFrame, keys: Sequence[str], t: str, tie: Sequence[str] = (), width_s: float = 3600.0,
            size: str | None = None) -> DataFrame:
    return ordered.dense_index(df, keys, [t, *tie], ordered.time_bucket(t, width_s), size=size)


# -- lookups ----------------------------------------------------------------

def asof_sample(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str],
                width_s: float, tie: Sequence[str] = ()) -> DataFrame:
    """Last sample at or before each probe; before the first sample, the first one."""
    both = ordered.asof_both(probes, samples, keys, t, payload, width_s, tie=tie)
    return both.withColumn("hit", F.coalesce("_back", "_ahead")).drop("_back", "_ahead")


def asof_interp(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, value: str, width_s: float,
                tie: Sequence[str] = (), step_at_null: bool = False) -> DataFrame:
    """Linear blend of the samples either side, held at the ends; adds ``interp``.

    With ``step_at_null`` a null neighbour gives the earlier sample unblended.
    """
    both = ordered.asof_both(probes, samples, keys, t, [value], width_s, tie=tie).withColumnsRenamed({"_back": "_a", "_ahead": "_b"})
    a, b = F.col(f"_a.{value}"), F.col(f"_b.{value}")
    span = F.col("_b.t") - F.col("_a.t")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - F.col("_a.t")) / span))
    blend = F.when(span > 0, a + (b - a) * u)
    held = F.when(F.col("_a").isNull(), b).otherwise(a)
    out = F.coalesce(blend, a if step_at_null else held)
    return both.withColumn("interp", F.when(F.col("_a").isNull(), b).otherwise(out)).drop("_a", "_b")


def next_sample(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str],
                width_s: float, tie: Sequence[str] = ()) -> DataFrame:
    """First sample at or after each probe; past the end, the last one."""
    both = ordered.asof_both(probes, samples, keys, t, payload, width_s, equal="ahead", tie=tie)
    return both.withColumn("hit", F.coalesce("_ahead", "_back")).drop("_back", "_ahead")


def nearest(probes: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str],
            width_s: float, within_s: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Closest sample in time, the earlier one on a tie; beyond ``within_s`` null."""
    both = ordered.asof_both(probes, samples, keys, t, payload, width_s, tie=tie).withColumnsRenamed({"_back": "_a", "_ahead": "_b"})
    da, db = F.col(t) - F.col("_a.t"), F.col("_b.t") - F.col(t)
    pick = F.when(F.col("_b").isNull() | (F.col("_a").isNotNull() & (da <= db)), F.col("_a")).otherwise(F.col("_b"))
    out = both.withColumn("hit", pick).drop("_a", "_b")
    if within_s is not None:
        out = out.withColumn("hit", F.when(F.abs(F.col(t) - F.col("hit.t")) <= within_s, F.col("hit")))
    return out


def nearest_index(t: Column, t0: Column, fps: Column, n: Column) -> Column:
    """Sample index nearest ``t`` at a constant rate; 0 before the start, -1 past the end."""
    i = F.floor((t - t0) * fps + 0.5)
    return F.when(n == 0, -1).when(i < 0, 0).when(i < n, i).otherwise(-1)


def tolerance_hits(positions: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, t: str, tol: Column,
                   tol_max: float, ids: Sequence[str]) -> DataFrame:
    """Positions (keys + ids) with at least one mark within tolerance."""
    slim = positions.select(*keys, *ids, at, tol.alias("_tol"))
    return ordered.band_pairs(slim, marks.select(*keys, t), keys, at, t, F.col("_tol"), tol_max).select(
        *keys, *ids).distinct()


def fast_counts(grids: DataFrame, hits: DataFrame, onsets: DataFrame, key: str, t: str, tol_max: float,
                tol_frac: float = 1 / 16, need: int = 3) -> DataFrame:
    """Counts whose sixteenth positions carry both hits and onsets, with an off-beat hit.

    ``grids`` has key, one, spc. Only positions that some hit can reach are made:
    each hit names the counts around it, so the position table follows the hits.
    """
    h = hits.join(grids, key)
    c = F.floor((F.col(t) - F.col("one")) / F.col("spc"))
    counts = h.select(key, "one", "spc", F.explode(F.sequence(c - 1, c + 1)).alias("c")).distinct()
    pos = (counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
           .withColumn("at", F.col("one") + (F.col("c") + F.col("j") / 4) * F.col("spc")))
    tol = F.col("spc") * tol_frac
    ids = ["c", "j"]
    hit = tolerance_hits(pos, hits, [key], "at", t, tol, tol_max, ids).withColumn("_h", F.lit(1))
    on = tolerance_hits(pos, onsets, [key], "at", t, tol, tol_max, ids).withColumn("_o", F.lit(1))
    per = hit.join(on, [key, *ids], "full").groupBy(key, "c").agg(
        F.sum(F.coalesce("_h", F.lit(0))).alias("hits"), F.sum(F.coalesce("_o", F.lit(0))).alias("onsets"),
        F.max(F.when(F.col("j").isin(1, 3), F.coalesce("_h", F.lit(0)))).alias("_off"))
    return per.filter((F.col("hits") >= need) & (F.col("onsets") >= need) & (F.col("_off") == 1)).drop("_off")


def count_positions(marks: DataFrame, keys: Sequence[str], t: str, tol_max: float, tol_frac: float, out: str) -> DataFrame:
    """keys, c, ``out``: the sixteenth positions of each count that carry a mark, as four bits.

    ``marks``: keys, t and their grid's one and spc. A mark names the positions within reach of it by
    arithmetic, so nothing is joined and each task sends one row per (keys, count).
    """
    tol = F.least(F.col("spc") * tol_frac, F.lit(float(tol_max)))
    step = F.col("spc") / 4
    # A little beyond the tolerance, for rounding; the comparison below decides.
    low = F.ceil((F.col(t) - tol - F.col("one")) / step - 1e-3)
    high = F.floor((F.col(t) + tol - F.col("one")) / step + 1e-3)
    x = marks.withColumn("_at", F.explode(F.when(low <= high, F.sequence(low, high))))
    x = x.withColumn("c", F.floor(F.col("_at") / 4)).withColumn("j", F.pmod("_at", F.lit(4)).cast("int"))
    near = F.abs(F.col("one") + (F.col("c") + F.col("j") / 4) * F.col("spc") - F.col(t)) <= tol
    bit = F.element_at(F.array(*[F.lit(1 << j) for j in range(4)]), F.col("j") + 1)
    return x.filter(near).groupBy(*keys, "c").agg(F.bit_or(bit).alias(out))


# -- neighbourhoods -----------------------------------------------------------

def moving_average(df: DataFrame, keys: Sequence[str], value: str, k: int, size: str = "n", out: str = "smooth") -> DataFrame:
    """Centred mean of 2k+1 rows with the first and last value repeated past the ends."""
    def build(frame):
        i, n, x = F.col("idx"), F.col(size), F.col(value)
        head = F.first(x).over(frame(-k, 0)) * F.greatest(F.lit(0), k - i)
        tail = F.last(x).over(frame(0, k)) * F.greatest(F.lit(0), k - (n - 1 - i))
        return {out: (F.sum(x).over(frame(-k, k)) + head + tail) / (2 * k + 1)}

    return ordered.row_frames(df, keys, k, build)


def gradient(df: DataFrame, keys: Sequence[str], t: str, values: dict[str, str]) -> DataFrame:
    """Second-order derivative on an uneven axis, one-sided at the ends; null for single rows."""
    def build(frame):
        w = frame(None, None)
        x0, x1 = F.lag(t).over(w), F.lead(t).over(w)
        hs, hd = F.col(t) - x0, x1 - F.col(t)
        made = {}
        for out, v in values.items():
            a, b, c = F.lag(v).over(w), F.col(v), F.lead(v).over(w)
            inner = (hs * hs * c + (hd * hd - hs * hs) * b - hd * hd * a) / (hs * hd * (hd + hs))
            made[out] = F.when(a.isNull(), (c - b) / hd).when(c.isNull(), (b - a) / hs).otherwise(inner)
        return made

    return ordered.row_frames(df, keys, 1, build)


def peaks(df: DataFrame, keys: Sequence[str], value: str, reach: int = 2, quantile: float = 0.75, size: str = "n") -> DataFrame:
    """Rows that are the maximum of their 2*reach+1 neighbours and above the series' quantile."""
    thr = exact_quantiles(df, keys, value, {"_thr": quantile})

    def build(frame):
        return {"_top": F.max(value).over(frame(-reach, reach))}

    near = ordered.row_frames(df, keys, reach, build)
    inside = (F.col("idx") >= reach) & (F.col("idx") < F.col(size) - reach)
    return near.filter(inside & (F.col(value) >= F.col("_top"))).join(thr, list(keys)).filter(
        F.col(value) > F.col("_thr")).drop("_top", "_thr")


def stop_cue(df: DataFrame, keys: Sequence[str], value: str, window: int | None, ok: Column | None = None, size: str = "n") -> DataFrame:
    """Local minima scored by prominence against the lower of the two neighbouring maxima; without a window, those of the whole key."""
    ok = F.lit(True) if ok is None else ok
    x = F.col(value)

    def build(frame):
        low = x <= F.min(x).over(frame(-2, 2))
        if window is None:
            return {"_low": low}
        return {"_low": low, "_back": F.max(x).over(frame(-window, -1)), "_ahead": F.max(x).over(frame(1, window))}

    halo = max(2, window or 0)
    out = ordered.row_frames(df, keys, halo, build, run=max(ordered.RUN_ROWS, halo))
    if window is None:
        out = ordered.max_both(out, keys, ["idx"], ordered.index_bucket(), x)
    ref = F.least(F.greatest("_back", F.lit(0.0)), F.greatest("_ahead", F.lit(0.0)))
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col(size) - 1)
    stop = F.when(inner & ok & F.col("_low"), F.greatest(F.lit(0.0), (ref - x) / (ref + 1e-6))).otherwise(0.0)
    return out.withColumn("stop", stop).drop("_low", "_back", "_ahead")


def turn_cue(df: DataFrame, keys: Sequence[str], components: Sequence[str], median: Column, ok: Column | None = None,
             size: str = "n") -> DataFrame:
    """Change of direction between the mean of three rows before and after, weighted by size."""
    ok = F.lit(True) if ok is None else ok

    def build(frame):
        a = [F.avg(c).over(frame(-3, -1)) for c in components]
        b = [F.avg(c).over(frame(1, 3)) for c in components]
        made = {f"_a{i}": x for i, x in enumerate(a)}
        made.update({f"_b{i}": x for i, x in enumerate(b)})
        return made

    near = ordered.row_frames(df, keys, 3, build)
    n = len(components)
    a, b = [F.col(f"_a{i}") for i in range(n)], [F.col(f"_b{i}") for i in range(n)]
    total = lambda terms: sum(terms[1:], terms[0])
    na, nb = F.sqrt(total([x * x for x in a])), F.sqrt(total([x * x for x in b]))
    cos = total([x * y for x, y in zip(a, b)]) / (na * nb + 1e-9)
    inner = (F.col("idx") >= 3) & (F.col("idx") < F.col(size) - 3)
    score = (1 - cos) / 2 * F.least(F.lit(1.0), F.least(na, nb) / median)
    return near.withColumn("turn", F.when(inner & ok, score).otherwise(0.0)).drop(
        *[f"_a{i}" for i in range(n)], *[f"_b{i}" for i in range(n)])


def median_filter(df: DataFrame, keys: Sequence[str], value: str, win: int = 5, out: str = "median") -> DataFrame:
    """Windowed median ignoring nulls; the value itself where the window has none."""
    half = win // 2

    def build(frame):
        return {out: F.coalesce(F.percentile(F.col(value), F.lit(0.5)).over(frame(-half, half)), F.col(value))}

    return ordered.row_frames(df, keys, half, build)


def local_linear(df: DataFrame, keys: Sequence[str], t: str, value: str, sigma_s: float, width_s: float,
                 out: str = "smooth") -> DataFrame:
    """Gaussian-weighted straight line through the neighbours within 3 sigma, read at each sample.

    A frame holds the samples of six sigma, which the sampling rate bounds.
    """
    def build(frame):
        return {"_near": F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("x"))).over(
            frame(-3 * sigma_s, 3 * sigma_s))}

    near = ordered.time_frames(df, keys, t, 3 * sigma_s, width_s, build)
    zero = F.struct(*[F.lit(0.0).alias(f) for f in ("s0", "s1", "s2", "x0", "x1")])

    def step(acc, p):
        d = p["t"] - F.col(t)
        w = F.exp(-0.5 * (d / sigma_s) * (d / sigma_s))
        return F.struct((acc["s0"] + w).alias("s0"), (acc["s1"] + w * d).alias("s1"), (acc["s2"] + w * d * d).alias("s2"),
                        (acc["x0"] + w * p["x"]).alias("x0"), (acc["x1"] + w * d * p["x"]).alias("x1"))

    m = F.col("_m")
    det = m["s0"] * m["s2"] - m["s1"] * m["s1"]
    line = F.when(det > 1e-9 * m["s0"] * m["s0"], (m["s2"] * m["x0"] - m["s1"] * m["x1"]) / det).otherwise(m["x0"] / m["s0"])
    return near.withColumn("_m", F.aggregate("_near", zero, step)).withColumn(out, line).drop("_near", "_m")


def steady_track(df: DataFrame, keys: Sequence[str], t: str, centres: Sequence[str], sigma_s: float,
                 width_s: float, tie: Sequence[str] = ()) -> DataFrame:
    """Gaussian mean of the centres inside each unbroken run of real rows; null rows stay null.

    Runs are numbered by the nulls seen so far, so nothing is averaged across a gap.
    """
    order = [t, *tie]
    gap = F.when(F.col(centres[0]).isNull(), 1).otherwise(0)
    runs = ordered.running_sum(df, keys, order, ordered.time_bucket(t, width_s), {"_gaps": gap})
    real = runs.filter(F.col(centres[0]).isNotNull())

    def build(frame):
        return {"_near": F.collect_list(F.struct(F.col(t).alias("t"), *[F.col(c).cast("double").alias(c) for c in centres])).over(
            frame(-3 * sigma_s, 3 * sigma_s))}

    near = ordered.time_frames(real, [*keys, "_gaps"], t, 3 * sigma_s, width_s, build)
    weigh = lambda p: F.exp(-0.5 * ((p["t"] - F.col(t)) / sigma_s) * ((p["t"] - F.col(t)) / sigma_s))
    total = F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + weigh(p))

    def mean(c: str) -> Column:
        return F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + weigh(p) * p[c]) / total

    made = {f"steady_{c}": mean(c) for c in centres}
    out = near.withColumns(made).drop("_near", "_gaps")
    lost = runs.filter(F.col(centres[0]).isNull()).drop("_gaps")
    return out.unionByName(lost, allowMissingColumns=True)


def crop_size(widths: Column, quantile: float = 0.9) -> Column:
    """The web rule for a quantile of an array: sorted[floor(q * (n - 1))]."""
    s = F.sort_array(widths)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(quantile * (F.size(s) - 1)) + 1).cast("int")))


def hold(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str = "held") -> DataFrame:
    """Forward fill, the leading gap filled from the first real value, with provenance flags."""
    src = {out: F.col(value)}
    fwd = ordered.carry_last(df, keys, order, bucket, src)
    both = ordered.carry_last(fwd, keys, order, bucket, {"_first": F.col(value)}, ahead=True)
    leading = F.col(out).isNull()
    return (both.withColumn("observed", F.col(value).isNotNull())
            .withColumn("interpolated", F.col(value).isNull() & ~leading)
            .withColumn("suppressed", F.when(F.col(value).isNotNull(), F.lit(None).cast("string"))
                        .when(leading, "out_of_frame").otherwise("low_confidence"))
            .withColumn(out, F.coalesce(out, "_first")).drop("_first"))


def sole_lift(df: DataFrame, keys: Sequence[str], gap: str, band: float = 0.05, size: str = "n", run: int = ordered.RUN_ROWS) -> DataFrame:
    """Lift that puts soles on the floor: blended between contact samples by index, averaged over three, never below clearance."""
    contact = F.when(F.col(gap) < band, F.struct(F.col("idx").alias("i"), F.col(gap).alias("g")))
    b = ordered.index_bucket("idx", run)
    back = ordered.carry_last(df, keys, ["idx"], b, {"_a": contact})
    both = ordered.carry_last(back, keys, ["idx"], b, {"_b": contact}, ahead=True)
    a, c = F.col("_a"), F.col("_b")
    between = -a["g"] + (a["g"] - c["g"]) * (F.col("idx") - a["i"]) / (c["i"] - a["i"])
    raw = (F.when(a.isNull() & c.isNull(), None).when(a.isNull(), -c["g"]).when(c.isNull(), -a["g"])
           .when(a["i"] == c["i"], -a["g"]).otherwise(between))
    flat = both.withColumn("_raw", raw).drop("_a", "_b")

    def build(frame):
        w = frame(None, None)
        x = F.col("_raw")
        near = (F.coalesce(F.lag(x).over(w), x) + x + F.coalesce(F.lead(x).over(w), x)) / 3
        return {"lift": F.when(x.isNull(), F.greatest(F.lit(0.0), -F.col(gap))).otherwise(F.greatest(near, -F.col(gap)))}

    return ordered.row_frames(flat, keys, 1, build, run=run).drop("_raw")


def hysteresis(df: DataFrame, keys: Sequence[str], clean: Column, frames: int = 3) -> DataFrame:
    """Degrade at once, recover only after ``frames`` clean rows in a row; adds ``usable``."""
    src = df.withColumn("_clean", clean.cast("int"))

    def build(frame):
        seen = F.count("_clean").over(frame(1 - frames, 0))
        return {"usable": (F.min("_clean").over(frame(1 - frames, 0)) == 1) & ((seen == frames) | (seen == F.col("idx") + 1))}

    return ordered.row_frames(src, keys, frames - 1, build).drop("_clean")


def parabola_vertex(a: Column, b: Column, c: Column) -> Column:
    """Offset of the extremum through three even points, in samples, held to half a sample."""
    den = a - 2 * b + c
    off = F.when(den > 1e-9, 0.5 * (a - c) / den).otherwise(0.0)
    return F.greatest(F.lit(-0.5), F.least(F.lit(0.5), off))


def close_contacts(df: DataFrame, keys: Sequence[str], t: str, dist: str, near: float, closing: float = 0.12,
                   seen: Column | None = None, size: str = "n") -> DataFrame:
    """Sub-sample moments where a distance dips below ``near`` after closing fast."""
    seen = F.lit(True) if seen is None else seen

    def build(frame):
        w = frame(None, None)
        d = F.col(dist)
        return {"_low": F.min(d).over(frame(-2, 2)), "_two": F.lag(d, 2).over(w), "_p": F.lag(d).over(w),
                "_q": F.lead(d).over(w), "_tn": F.lead(t).over(w)}

    x = ordered.row_frames(df, keys, 2, build)
    inner = (F.col("idx") >= 2) & (F.col("idx") < F.col(size) - 2)
    d = F.col(dist)
    hit = inner & seen & (d < near) & (d <= F.col("_low")) & (F.col("_two") - d > closing)
    at = F.col(t) + parabola_vertex(F.col("_p"), d, F.col("_q")) * (F.col("_tn") - F.col(t))
    return x.filter(hit).withColumn("contact_t", at).drop("_low", "_two", "_p", "_q", "_tn")


def unwrap(df: DataFrame, keys: Sequence[str], angle: str, run: int = ordered.RUN_ROWS) -> DataFrame:
    """Angle series without jumps above pi; adds ``unwrapped``."""
    def build(frame):
        d = F.col(angle) - F.lag(angle).over(frame(None, None))
        turns = F.floor((d + TWO_PI / 2) / TWO_PI)
        # A step of exactly +pi stays positive, as numpy keeps it.
        turns = F.when((d + TWO_PI / 2 == turns * TWO_PI) & (d > 0), turns - 1).otherwise(turns)
        return {"_turns": F.coalesce(turns, F.lit(0))}

    x = ordered.row_frames(df, keys, 1, build, run=run)
    x = ordered.running_sum(x, keys, ["idx"], ordered.index_bucket("idx", run), {"_all": F.col("_turns")})
    return x.withColumn("unwrapped", F.col(angle) - F.col("_all") * TWO_PI).drop("_turns", "_all")


def runs_of(df: DataFrame, keys: Sequence[str], flag: Column, run: int = ordered.RUN_ROWS) -> DataFrame:
    """Number the runs of equal flag along ``idx``; adds ``run`` and ``flag``."""
    x = df.withColumn("flag", flag)

    def build(frame):
        same = F.lag("flag").over(frame(None, None)).eqNullSafe(F.col("flag"))
        return {"_new": F.when((F.col("idx") == 0) | ~same, 1).otherwise(0)}

    x = ordered.row_frames(x, keys, 1, build, run=run)
    return ordered.running_sum(x, keys, ["idx"], ordered.index_bucket("idx", run), {"run": F.col("_new")}).drop("_new")


# Reasons that come from motion alone, and the shortest pause.
MOTION_REASONS = ("walking", "still")
IDLE_INSIDE = 4


def idle_reason(seen: Column, music: Column, limb: Column, root: Column) -> Column:
    return (F.when(seen < 0.5, "not in frame").when(music < 0.2, "no music")
            .when((limb < 0.5) & (root > 0.6), "walking").when((limb < 0.35) & (root < 0.6), "still"))


def idle_spans(counts: DataFrame, keys: Sequence[str], why: str = "why", t0: str = "t0", t1: str = "t1",
               size: str = "n") -> DataFrame:
    """Lead-in, outro and long pauses of each key's counts (rows with ``idx``).

    The dance starts at the first two dancing counts in a row and ends after the
    last two; an edge with fewer than two motion-only idle counts is not trimmed.
    """
    by = list(keys)
    idle = F.col(why).isNotNull()

    def build(frame):
        w = frame(None, None)
        return {"_pair": ~idle & F.lead(F.col(why).isNull()).over(w), "_back": ~idle & F.lag(F.col(why).isNull()).over(w)}

    rows = ordered.row_frames(counts, keys, 1, build)
    edge = rows.groupBy(*by).agg(F.min(F.when(F.col("_pair"), F.col("idx"))).alias("_l"), F.max(F.when(F.col("_back"), F.col("idx"))).alias("_t"),
                                 F.max(size).alias("_n"))
    edge = edge.withColumn("_lead", F.coalesce("_l", "_n")).withColumn(
        "_tail", F.when(F.col("_t") > F.col("_lead"), F.col("_t") + 1).otherwise(F.col("_lead")))
    j = rows.join(edge, by)
    motion, other = F.col(why).isin(*MOTION_REASONS), idle & ~F.col(why).isin(*MOTION_REASONS)
    before, after = F.col("idx") < F.col("_lead"), F.col("idx") >= F.col("_tail")
    sides = j.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("_lead", "_tail", "_n")],
        (F.count_if(before & F.coalesce(motion, F.lit(False))) < 2).alias("_m0"), (F.count_if(before & other) == 0).alias("_o0"),
        (F.count_if(after & F.coalesce(motion, F.lit(False))) < 2).alias("_m1"), (F.count_if(after & other) == 0).alias("_o1"))
    cut = sides.select(*by, "_n", F.when((F.col("_lead") < F.col("_n")) & F.col("_m0") & F.col("_o0"), 0).otherwise(
        F.col("_lead")).alias("_lead"), "_tail", "_m1", "_o1")
    cut = cut.withColumn("_tail", F.when((F.col("_tail") > F.col("_lead")) & F.col("_m1") & F.col("_o1"), F.col("_n")).otherwise(F.col("_tail")))
    numbered = runs_of(rows.drop("_pair", "_back"), keys, idle).join(cut.select(*by, "_lead", "_tail"), by)
    kind = (F.when(F.col("idx") < F.col("_lead"), "lead-in").when(F.col("idx") >= F.col("_tail"), "outro")
            .when(F.col("flag"), "pause"))
    spans = numbered.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    group = F.when(F.col("kind") == "pause", F.col("run")).otherwise(-1)
    reason = F.coalesce(F.col(why), F.lit("one lively count"))
    return (spans.groupBy(*by, "kind", group.alias("_g")).agg(
        F.min(t0).alias("t0"), F.max(t1).alias("t1"), F.count("*").alias("counts"),
        F.array_sort(F.collect_set(reason)).alias("why"))
        .filter((F.col("kind") != "pause") | (F.col("counts") >= IDLE_INSIDE)).drop("_g"))


# -- rhythm -----------------------------------------------------------------

def contact_weights(df: DataFrame, keys: Sequence[str], clip: Sequence[str], t: str, height: str, valid: Column,
                    band: float = 0.06, max_speed: float = 0.30, envelope: float = 0.05, width_s: float = 3600.0) -> DataFrame:
    """Height-band times vertical-speed ramp for each foot sample; null-speed samples weigh 0.

    ``keys`` name one foot's series, ``clip`` the group whose low envelope is the floor guess.
    """
    good = df.filter(valid)
    floor = exact_quantiles(good, clip, height, {"_floor": envelope})
    g = gradient(indexed(good, keys, t, width_s=width_s), keys, t, {"_dh": height})
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col(height) - F.col("_floor")) / band))
    slow = F.when(F.col("_dh").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs("_dh") / max_speed)))
    weighed = g.join(floor, list(clip)).withColumn("weight", F.coalesce(near * slow, F.lit(0.0))).drop("_dh", "_floor", "idx")
    return weighed.unionByName(df.filter(~F.coalesce(valid, F.lit(False))).withColumn("weight", F.lit(0.0)))


def image_contact_weights(df: DataFrame, keys: Sequence[str], t: str, u: str, v: str, depth: str, focal: Column,
                          valid: Column, max_speed: float = 0.30, width_s: float = 3600.0) -> DataFrame:
    """The image-speed variant: a planted foot is a still pixel, scaled to metres by its own depth."""
    good = df.filter(valid & F.col(depth).isNotNull())
    g = gradient(indexed(good, keys, t, width_s=width_s), keys, t, {"_du": u, "_dv": v})
    speed = F.hypot("_du", "_dv") * F.col(depth) / focal
    return g.withColumn("weight", F.when(speed.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - speed / max_speed))).otherwise(0.0)).drop(
        "_du", "_dv", "idx")


def normalise(df: DataFrame, keys: Sequence[str], value: str, quantile: float, positive_only: bool = False,
              out: str = "normal", floor: float = 1e-9) -> DataFrame:
    """Value over a quantile of its own series."""
    src = df.filter(F.col(value) > 0) if positive_only else df
    scale = exact_quantiles(src, keys, value, {"_scale": quantile})
    return df.join(scale, list(keys), "left").withColumn(out, F.col(value) / (F.col("_scale") + floor)).drop("_scale")


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str, lo: int, hi: int) -> DataFrame:
    """Normalised autocorrelation at lags lo..hi-1 and the best of them.

    Lags are bounded, so each row reads its lagged partner from a halo of ``hi``
    rows; nothing is joined with itself.
    """
    by = list(keys)
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.count("*").alias("_n"))

    def build(frame):
        w = frame(None, None)
        return {f"_l{g}": F.lag(value, g).over(w) for g in range(lo, hi)}

    x = ordered.row_frames(df, keys, hi - 1, build).join(stats, by)
    v, m = F.col(value), F.col("_mean")
    sums = x.groupBy(*by).agg(*[F.sum((v - m) * (F.col(f"_l{g}") - m)).alias(f"_s{g}") for g in range(lo, hi)],
                              F.max("_var").alias("_var"), F.max("_n").alias("_n"))
    table = sums.select(*by, F.posexplode(F.array(*[
        F.coalesce(F.col(f"_s{g}"), F.lit(0.0)) / (F.col("_var") * F.col("_n")) for g in range(lo, hi)])).alias("lag", "r"))
    return table.withColumn("lag", (F.col("lag") + lo).cast("bigint"))


def phase_histogram(df: DataFrame, keys: Sequence[str], t: str, one: Column, spc: Column, bins: int = 8) -> DataFrame:
    phase = F.pmod((F.col(t) - one) / spc, F.lit(1.0))
    return df.groupBy(*keys, F.floor(phase * bins).cast("bigint").alias("bin")).agg(F.count("*").alias("hits"))


def half_beat_offset(t: Column, one: Column, spc: Column) -> Column:
    """Signed offset in ms from the nearest half-beat, null beyond a quarter of it."""
    dev = F.pmod((t - one) / (spc / 2) + 0.5, F.lit(1.0)) - 0.5
    return F.when(F.abs(dev) <= 0.25, dev * spc / 2 * 1000)


def fourier_at(df: DataFrame, keys: Sequence[str], t: str, value: str, one: Column, spc: Column,
               freqs: Sequence[int] = (1, 2)) -> DataFrame:
    """Beat-frequency component: phase of the trough in ms, its strength, and the beat-lock share.

    Two passes of plain sums: the mean first, then the rotated sums around it.
    """
    by = list(keys)
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.count("*").alias("n"))
    x = df.join(mean, by).withColumn("_d", F.col(value) - F.col("_mean")).withColumn(
        "_ph", TWO_PI * (F.col(t) - one) / spc)
    parts = []
    for f in freqs:
        parts += [F.sum(F.col("_d") * F.cos(f * F.col("_ph"))).alias(f"_c{f}"), F.sum(F.col("_d") * F.sin(f * F.col("_ph"))).alias(f"_s{f}")]
    g = x.groupBy(*by).agg(*parts, F.sum(F.col("_d") * F.col("_d")).alias("_ss"), F.max("n").alias("n"), F.max(spc).alias("_spc"))
    c, s = F.col("_c1"), -F.col("_s1")
    peak = F.pmod(-F.atan2(s, c) / TWO_PI, F.lit(1.0))
    trough = F.pmod(F.pmod(peak + 0.5, F.lit(1.0)) + 0.5, F.lit(1.0)) - 0.5
    power = sum(F.col(f"_c{f}") * F.col(f"_c{f}") + F.col(f"_s{f}") * F.col(f"_s{f}") for f in freqs)
    lock = F.when((F.col("n") > 8) & (F.col("_ss") > 0), F.least(F.lit(1.0), power * 2 / (F.col("n") * F.col("_ss")))).otherwise(0.0)
    return g.select(*by, "n", F.bround(1000 * trough * F.col("_spc")).cast("bigint").alias("trough_ms"),
                    (F.sqrt(c * c + s * s) / (F.sqrt(F.col("_ss") * F.col("n")) + 1e-9)).alias("strength"), lock.alias("lock"))


def xcorr_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], t: str, value: str, max_lag: int, step_s: float,
              width_s: float, tie: Sequence[str] = ()) -> DataFrame:
    """Correlation of two series on a common grid at every lag within +-max_lag steps.

    Both are read on the same grid by interpolation; a lag then is a row offset of
    one of them, taken from a halo, and each lag's sums combine map-side.
    """
    by = list(keys)
    span = lambda df, p: df.groupBy(*by).agg(F.min(t).alias(f"_{p}0"), F.max(t).alias(f"_{p}1"))
    ends = span(a, "a").join(span(b, "b"), by)
    lo = F.greatest("_a0", "_b0") + max_lag * step_s
    hi = F.least("_a1", "_b1") - max_lag * step_s
    n = F.ceil((hi - lo) / step_s)
    # The grid grows with the series' span; blocks keep one row from exploding into all of it.
    block = 4096
    grid = (ends.withColumn("_lo", lo).withColumn("_n", n.cast("bigint")).filter("_n > 0")
            .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") + 2 * max_lag - 1) / block))))
            .withColumn("g", F.explode(F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.col("_n") + 2 * max_lag) - 1))))
    grid = grid.select(*by, "_n", (F.col("g") - max_lag).alias("g"), (F.col("_lo") + (F.col("g") - max_lag) * step_s).alias(t))
    onb = asof_interp(grid, b, keys, t, value, width_s, tie).withColumnRenamed("interp", "_bv")
    both = asof_interp(onb, a, keys, t, value, width_s, tie).withColumnRenamed("interp", "_av")
    both = both.withColumn("idx", F.col("g") + max_lag)

    def build(frame):
        w = frame(None, None)
        return {f"_k{k}": (F.lead("_bv", k).over(w) if k >= 0 else F.lag("_bv", -k).over(w)) for k in range(-max_lag, max_lag + 1)}

    x = ordered.row_frames(both, keys, max_lag, build).filter((F.col("g") >= 0) & (F.col("g") < F.col("_n")))
    sums = x.groupBy(*by).agg(*[F.corr("_av", F.col(f"_k{k}")).alias(f"_r{i}") for i, k in enumerate(range(-max_lag, max_lag + 1))])
    table = sums.select(*by, F.posexplode(F.array(*[F.col(f"_r{i}") for i in range(2 * max_lag + 1)])).alias("_i", "r"))
    return table.select(*by, (F.col("_i") - max_lag).cast("bigint").alias("lag"), "r")


def best_lag(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.max_by("lag", F.struct(F.coalesce("r", F.lit(-9.0)), -F.col("lag"))).alias("lag"),
                                    F.max("r").alias("r"))


def implausible(df: DataFrame, keys: Sequence[str], t: str, xyz: Sequence[str], max_speed: float = 8.0,
                max_accel: float = 150.0) -> DataFrame:
    """Speed and acceleration gates on a position series; adds speed, accel, rejected."""
    def build(frame):
        w = frame(None, None)
        made = {"_dt": F.col(t) - F.lag(t).over(w), "_dt0": F.lag(t).over(w) - F.lag(t, 2).over(w)}
        for c in xyz:
            made[f"_v_{c}"] = (F.col(c) - F.lag(c).over(w)) / (F.col(t) - F.lag(t).over(w))
            made[f"_u_{c}"] = (F.lag(c).over(w) - F.lag(c, 2).over(w)) / (F.lag(t).over(w) - F.lag(t, 2).over(w))
        return made

    x = ordered.row_frames(df, keys, 2, build)
    total = lambda terms: sum(terms[1:], terms[0])
    speed = F.sqrt(total([F.col(f"_v_{c}") * F.col(f"_v_{c}") for c in xyz]))
    accel = F.sqrt(total([(F.col(f"_v_{c}") - F.col(f"_u_{c}")) * (F.col(f"_v_{c}") - F.col(f"_u_{c}")) for c in xyz])) / F.col("_dt")
    return (x.withColumn("speed", speed).withColumn("accel", accel)
            .withColumn("rejected", F.coalesce(F.col("speed") > max_speed, F.lit(False)) | F.coalesce(F.col("accel") > max_accel, F.lit(False)))
            .drop("_dt", "_dt0", *[f"_v_{c}" for c in xyz], *[f"_u_{c}" for c in xyz]))


def grid_score(positions: DataFrame, cues: DataFrame, envelope: DataFrame | None, key: str, t: str, reach: Column,
               reach_max: float, accent_reach: float = 0.04, accent_weight: float = 0.3) -> DataFrame:
    """Score every grid position by the strongest cue near it, lifted by the loudest accent.

    ``positions`` has key, q, at, level (0-3) and fast; sub-beats (level 3) score 0.9
    when fast and 0 otherwise. The first of equal cues wins.
    """
    slim = positions.select(key, "q", "at", reach.alias("_reach"))
    near = ordered.band_pairs(slim, cues.select(key, F.col(t).alias("_ct"), "cue"), [key], "at", "_ct", F.col("_reach"), reach_max)
    best = near.groupBy(key, "q").agg(F.max_by(F.struct("cue", (F.col("_ct") - F.col("at")).alias("offset")),
                                               F.struct("cue", -F.col("_ct"))).alias("_b"))
    out = positions.join(best, [key, "q"], "left")
    score = F.coalesce(F.col("_b.cue"), F.lit(0.0))
    if envelope is not None:
        loud = ordered.band_pairs(positions.select(key, "q", "at"), envelope.select(key, F.col(t).alias("_et"), "env"), [key],
                                  "at", "_et", accent_reach, accent_reach).groupBy(key, "q").agg(F.max("env").alias("_env"))
        out = out.join(loud, [key, "q"], "left")
        acc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_env", F.lit(0.0))))
        score = F.least(F.lit(1.0), score * (1 + accent_weight * acc))
        out = out.withColumn("score", score).drop("_env")
    else:
        out = out.withColumn("score", score)
    forced = F.when(F.col("fast"), 0.9).otherwise(0.0)
    found = F.col("_b").isNotNull()
    return (out.withColumn("score", F.when(~found, 0.0).when(F.col("level") == 3, forced).otherwise(F.col("score")))
            .withColumn("offset", F.when(found, F.col("_b.offset"))).drop("_b"))


def reduce_by(detector: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """Apply a pluggable detector: any DataFrame -> DataFrame function that adds ``weight`` in [0, 1]."""
    out = detector(df)
    if "weight" not in out.columns:
        raise ValueError("a detector must add a weight column")
    return out.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))))
