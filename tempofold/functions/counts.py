"""Count-grid arithmetic as column expressions.

A grid is ``one`` (seconds of count 1), ``spc`` (seconds per count) and a total.
Rounding follows the language each rule was written for: half-even (``bround``)
for the service side, floor(x + 0.5) for the browser side.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLIP_EDGE_S = 0.02  # a beat this close before 0 still counts as inside the clip
SPEED_MIN, SPEED_MAX, SPEED_GRID = 0.25, 1.25, 20


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def floor_mod(x: Column, n) -> Column:
    return F.pmod(x, lit(n))


def clamp(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.greatest(lit(lo), F.least(lit(hi), x)))


def time_of_count(one: Column, spc: Column, count: Column) -> Column:
    return one + (count - 1) * spc


def count_at_time(one: Column, spc: Column, t: Column) -> Column:
    return (t - one) / spc + 1


def current_count(one: Column, spc: Column, total: Column, t: Column) -> Column:
    return clamp(F.floor(count_at_time(one, spc, t)), F.lit(1).cast("bigint"), total)


def nearest_boundary(one: Column, spc: Column, total: Column, t: Column) -> Column:
    return clamp(js_round(count_at_time(one, spc, t)), F.lit(1).cast("bigint"), total + 1)


def eight_start(count: Column) -> Column:
    return F.floor((count - 1) / 8) * 8 + 1


def count_label(count: Column) -> Column:
    """1-8 inside the eight; the browser's remainder keeps the sign of ``count - 1``."""
    return (count - 1) % 8 + 1


def count_total(one: Column, spc: Column, end: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor((end - one) / spc) + 1)


def metrical(q: Column) -> Column:
    """0 = count 1 or 5, 1 = other counts, 2 = "and", 3 = "e" / "a"."""
    return (F.when(F.pmod(q, F.lit(16)) == 0, 0).when(F.pmod(q, F.lit(4)) == 0, 1)
            .when(F.pmod(q, F.lit(2)) == 0, 2).otherwise(3))


def quarter_label(q: Column) -> Column:
    """0 -> '1', 1 -> '1e', 2 -> '1&', 3 -> '1a', 4 -> '2' ... inside an eight."""
    number = F.pmod(F.floor(q / 4), F.lit(8)) + 1
    part = F.element_at(F.array(*map(F.lit, ("", "e", "&", "a"))), (F.pmod(q, F.lit(4)) + 1).cast("int"))
    return F.concat(number.cast("string"), part)


def snap(one: Column, spc: Column, requested: Column, end: Column) -> Column:
    """Nearest grid beat: struct(t, beats, reason); t is null past the clip's end."""
    k0 = F.bround((requested - one) / spc).cast("bigint")
    early = one + k0 * spc < 0
    k = F.when(early, k0 + 1).otherwise(k0)
    t0 = one + k0 * spc
    t = F.when(early, t0 + spc).otherwise(t0)
    late = t > end
    return F.struct(F.when(~late, F.bround(t, 6)).alias("t"), F.when(~late, k).alias("beats"),
                    F.when(late, F.lit("off_grid")).alias("reason"))


def rebase(pc: Column, requested: Column, end: Column) -> Column:
    """Move a proposal's count 1; alternates are re-expressed from the new 1.

    ``pc`` is a struct with count_one_s, seconds_per_count and
    count_one_alternates (array of struct count_one_s, shift_counts, confidence);
    its other fields are kept.
    """
    spc, old = pc["seconds_per_count"], pc["count_one_s"]
    at = snap(old, spc, requested, end)
    new, k = at["t"], at["beats"]
    olds = F.coalesce(pc["count_one_alternates"],
                      F.expr("cast(array() as array<struct<count_one_s:double,shift_counts:bigint,confidence:double>>)"))
    spent = F.aggregate(olds, F.lit(0.0), lambda acc, a: acc + a["confidence"])
    share = F.bround(clamp(1.0 - spent, 0.0, 1.0), 3)

    def alt(t, shift, conf):
        return F.struct(t.cast("double").alias("count_one_s"), shift.cast("bigint").alias("shift_counts"),
                        conf.cast("double").alias("confidence"))

    moved = F.transform(olds, lambda a: alt(a["count_one_s"], F.bround((a["count_one_s"] - new) / spc), a["confidence"]))
    moved = F.filter(moved, lambda a: F.pmod(a["shift_counts"], F.lit(4)) != 0)
    first = F.filter(F.array(alt(old, -k, share)), lambda a: F.pmod(k, F.lit(4)) != 0)
    alts = F.filter(F.concat(first, moved), lambda a: (a["count_one_s"] >= 0) & (a["count_one_s"] <= end))
    alts = F.slice(alts, 1, 3)
    # Every other field of the proposal stays as it is.
    out = (pc.withField("count_one_s", new).withField("moved_beats", k).withField("count_total", count_total(new, spc, end))
           .withField("count_one_source", F.lit("owner")).withField("count_one_confidence", F.lit(1.0)).withField("count_one_alternates", F.when(F.size(alts) > 0, alts)))
    return F.when(at["reason"].isNull(), out)


def carried_pick(picked: Column, shift_self: Column, shift_copy: Column, one: Column, spc: Column,
                 end: Column) -> Column:
    """An owner's count 1 carried to a copy: same eight, or same four when eight runs off the end."""
    t = picked - shift_self + shift_copy

    def want(counts: int) -> Column:
        span = F.lit(counts) * spc
        w = F.pmod(t, span)
        return F.when(w < spc / 2, w + span).otherwise(w)

    eight, four = snap(one, spc, want(8), end), snap(one, spc, want(4), end)
    ok = F.when(eight["reason"].isNull(), eight).otherwise(four)
    return F.when(spc.isNull() | (spc == 0),
                  F.struct(F.lit(None).cast("double").alias("t"), F.lit(None).cast("bigint").alias("beats"),
                           F.lit("no beat grid").alias("reason"))).otherwise(ok)


def leading_eights(one: Column, spc: Column) -> Column:
    """Whole eights to put before count 1 so the counts reach the clip's first beat."""
    return F.ceil(F.floor((one + CLIP_EDGE_S) / spc) / 8)


def set_one(one: Column, spc: Column, t: Column) -> Column:
    eight = 8 * spc
    return t - eight * js_round((t - one) / eight)


def nudge(one: Column, spc: Column, by: Column) -> Column:
    return one + js_round(by) * spc


def tap_on_one(one: Column, spc: Column, tap: Column) -> Column:
    beats = js_round((tap - one) / spc)
    return nudge(one, spc, beats - 8 * js_round(beats / 8))


def retempo_spc(spc: Column, double: bool) -> Column:
    return spc / 2 if double else spc * 2


def retempo_count(count: Column, double: bool) -> Column:
    return 2 * count - 1 if double else js_round((count + 1) / 2)


def bar_options(one: Column, spc: Column) -> Column:
    """The four grid beats of the first bar at or after 0 s."""
    first = one - F.floor(one / spc + 1e-6) * spc
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.round(first + i * spc, 3))


def option_of(t: Column, one: Column, spc: Column) -> Column:
    return F.pmod(js_round((t - F.element_at(bar_options(one, spc), 1)) / spc), F.lit(4))


def beat_at(t: Column, origin: Column, spc: Column) -> Column:
    beat = F.floor((t - origin) / spc + 1e-3)
    return F.struct(beat.alias("beat"), (F.pmod(beat, F.lit(8)) + 1).alias("count"))


def loop_at(start: Column, length, total: Column) -> Column:
    s = clamp(start, F.lit(1).cast("bigint"), total)
    return F.struct(s.alias("start_count"), F.least(s + lit(length) - 1, total).alias("end_count"))


def window_at(count: Column, length, total: Column) -> Column:
    c = clamp(count, F.lit(1).cast("bigint"), total)
    return loop_at(F.floor((c - 1) / lit(length)) * lit(length) + 1, length, total)


def step_loop(loop: Column, here: Column, length: int, delta: int, total: Column) -> Column:
    if delta > 0:
        start = loop["end_count"] + 1 + (delta - 1) * length
        moved = F.when(start > total, loop).otherwise(loop_at(start, length, total))
    elif delta < 0:
        start = F.greatest(F.lit(1).cast("bigint"), loop["start_count"] + delta * length)
        moved = F.when(loop["start_count"] <= 1, loop).otherwise(loop_at(start, length, total))
    else:
        moved = loop_at(loop["start_count"], length, total)
    return F.when(loop.isNull(), window_at(here + delta * length, length, total)).otherwise(moved)


def build_up_speed(passes: Column) -> Column:
    return F.least(F.lit(1.0), js_round((0.5 + 0.1 * F.greatest(F.lit(0), passes)) * 100) / 100)


def clamp_speed(s: Column) -> Column:
    held = js_round(clamp(s, SPEED_MIN, SPEED_MAX) * SPEED_GRID) / SPEED_GRID
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(1.0)).otherwise(held)


def one_alternates(alts: Column, one: Column, spc: Column, unsure: Column) -> Column:
    """Other candidates for count 1: wrapped to -4..3, first kept first, rest in count order."""
    tagged = F.transform(alts, lambda a: F.struct(
        a["count_one_s"].alias("count_one_s"),
        (F.pmod(js_round((a["count_one_s"] - one) / spc) + 4, F.lit(8)) - 4).alias("by")))
    kept = F.filter(tagged, lambda a: F.abs(a["by"]) > F.when(unsure, 0).otherwise(1))
    distinct = F.filter(kept, lambda a, i: ~F.exists(F.slice(kept, 1, i), lambda b: b["by"] == a["by"]))
    tail = F.array_sort(F.transform(F.slice(distinct, 2, 100000), lambda a: F.struct(a["by"], a["count_one_s"])))
    tail = F.transform(tail, lambda a: F.struct(a["count_one_s"].alias("count_one_s"), a["by"].alias("by")))
    return F.concat(F.slice(distinct, 1, 1), tail)


def counts_milestone(grid: Column) -> Column:
    """Beat proposal as the live status shows it; null without a usable grid."""
    good = grid.isNotNull() & (grid["seconds_per_count"] > 0)
    return F.when(good, F.struct(
        F.bround(grid["bpm"], 2).alias("bpm"), F.bround(grid["count_one_s"], 4).alias("count_one_s"),
        F.bround(grid["seconds_per_count"], 5).alias("seconds_per_count"),
        F.bround(F.coalesce(grid["confidence"], F.lit(0.0)), 3).alias("confidence")))
