"""Evaluation: ranking quality, operating points, rule sweeps, motion features, null distributions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quat import let
from . import ordered, series
from .quantiles import exact_quantiles, value_bin

# Thresholds of the dance gate.
CLIP_MIN, STILL_MAX, PERSON_MIN, LIMB_MIN = 0.4, 0.1, 0.3, 0.02
OURS = ("job_", "eval_", "synth_")


def labelled(scores: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scores with a label; rows without one drop."""
    return scores.join(labels, list(key))


def relabel(manifest: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Apply a correction list (key, new_label); the old label is kept where it changed."""
    j = manifest.join(corrections, key, "left")
    changed = F.col("new_label").isNotNull() & (F.col("new_label") != F.col("label"))
    return j.withColumn("relabelled_from", F.when(changed, F.col("label"))).withColumn(
        "label", F.coalesce("new_label", "label")).drop("new_label")


def auc(scored: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Share of positive-negative pairs ranked right, ties half; no pair is ever formed.

    Rows are first counted per distinct score; a running count of negatives over
    value bins then says how many pairs each score wins.
    """
    by = list(keys)
    per = scored.groupBy(*by, F.col(score).alias("_v")).agg(F.sum(F.col(positive).cast("int")).alias("_p"),
                                                           F.sum(1 - F.col(positive).cast("int")).alias("_n"))
    run = ordered.running_sum(per, by, ["_v"], value_bin(F.col("_v")), {"_upto": F.col("_n")})
    wins = F.sum(F.col("_p") * (F.col("_upto") - F.col("_n") / 2))
    g = run.groupBy(*by).agg(wins.alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return g.select(*by, "n_pos", "n_neg", (F.col("_w") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def operating_point(scored: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Highest threshold that passes every positive, and the share of negatives it rejects."""
    by = list(keys)
    pos = F.col(positive)
    floor = scored.groupBy(*by).agg(F.min(F.when(pos, F.col(score))).alias("min_pos"))
    return scored.filter(~pos).join(floor, by).groupBy(*by).agg(
        F.max("min_pos").alias("min_pos"), F.count("*").alias("n_neg"),
        F.avg((F.col(score) < F.col("min_pos")).cast("int")).alias("neg_rejected"))


def confusion(scored: DataFrame, keys: Sequence[str], passes: dict[str, Column], positive: Column, ours: Column | None = None) -> DataFrame:
    """Confusion numbers of every named rule in one pass over the rows.

    ``passes`` maps a rule name to "the clip is let through". Divisions by zero are null.
    """
    by = list(keys)
    ours = F.lit(False) if ours is None else ours
    sums, cells = [], []
    for i, (name, ok) in enumerate(passes.items()):
        sums += [F.count_if(positive & ok).alias(f"_tp{i}"), F.count_if(positive & ~ok).alias(f"_fn{i}"),
                 F.count_if(~positive & ok).alias(f"_fp{i}"), F.count_if(~positive & ~ok).alias(f"_tn{i}"),
                 F.count_if(positive & ours & ~ok).alias(f"_ou{i}")]
        cells.append(F.struct(F.lit(name).alias("rule"), *[F.col(f"_{c}{i}").alias(c) for c in ("tp", "fn", "fp", "tn", "ou")]))
    g = scored.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*cells)))
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return g.select(*by, "rule", share(tp, tp + fn).alias("recall"), fn.alias("false_rejects"), F.col("ou").alias("ours_rejected"),
                    share(tp, tp + fp).alias("precision"), share(tn, tn + fp).alias("neg_rejected"))


def thresholds(score: str, values: Sequence[float]) -> dict[str, Column]:
    return {f"{v:g}": F.col(score) >= v for v in values}


def gate_reasons(dance: Column, still: Column, person: Column, limb: Column, clip_min: float = CLIP_MIN) -> Column:
    """Reasons to refuse a clip, empty when it is accepted; absent pose scores refuse nothing."""
    return F.array_compact(F.array(
        F.when(dance < clip_min, "looks_like_something_else"), F.when(still < STILL_MAX, "nothing_moves"),
        F.when(person < PERSON_MIN, "no_person"), F.when((person >= PERSON_MIN) & (limb < LIMB_MIN), "nobody_moves")))


def still_or_empty(person: Column, limb: Column) -> Column:
    return (person < PERSON_MIN) | (limb < LIMB_MIN)


def gate_signals() -> dict[str, Column]:
    """What may speak for a refusal, over columns clip, smolvlm, xclip, kinetics, person, full_body, limb and the lite pair."""
    c = F.col
    return {
        "clip50": c("clip") < 0.5, "clip40": c("clip") < 0.4, "smolvlm15": c("smolvlm") < 0.15, "xclip20": c("xclip") < 0.2, "kinetics0.5": c("kinetics") < 0.005,
        "nobody": c("person") < 0.3, "partial": c("full_body") < 0.15, "frozen": c("limb") < 0.02, "lite": still_or_empty(c("lite_person"), c("lite_limb")),
    }


#: Combinations that are compared: a rule refuses when one of its signals does, and is called by their names.
COMPARED = (("lite",), ("clip50", "lite"), ("clip40", "lite"), ("clip50",), ("clip40",), ("smolvlm15",), ("xclip20",), ("kinetics0.5",), ("nobody",), ("nobody", "partial"), ("nobody", "partial", "frozen"),
            ("clip50", "nobody", "partial", "frozen"), ("clip40", "nobody", "partial", "frozen"), ("smolvlm15", "nobody", "partial", "frozen"))


def gate_rules(combinations: Sequence[Sequence[str]] = COMPARED) -> dict[str, Column]:
    signals = gate_signals()
    return {"+".join(names): functools.reduce(operator.or_, (signals[n] for n in names)) for names in combinations}


def sweep(scored: DataFrame, keys: Sequence[str], rules: dict[str, Column], positive: Column, ours: Column | None = None) -> DataFrame:
    """``confusion`` for rules that refuse; null scores refuse nothing."""
    return confusion(scored, keys, {n: ~F.coalesce(r, F.lit(False)) for n, r in rules.items()}, positive, ours)


def motion_score(person: Column, limb: Column, rhythm: Column, n_beats: Column, beat_cv: Column) -> Column:
    """Own-signal score in [0, 1]: presence times movement, with rhythm and music only adding."""
    one = lambda x: F.least(F.lit(1.0), x)
    music = F.when((n_beats >= 8) & (beat_cv < 0.25), 1.0).otherwise(0.0)
    move = 0.6 * one(limb) + 0.2 * F.greatest(F.lit(0.0), one(rhythm / 0.5)) + 0.2 * music
    return F.when(person < PERSON_MIN, 0.0).otherwise(one(move) * one(person / 0.6))


def keypoint_motion(kp: DataFrame, clip: str, fps: float, max_speed: float = 8.0, min_conf: float = 0.3,
                    size: str = "n") -> DataFrame:
    """Motion features per clip from one row per frame: present, and limbs as arrays of (x, y, conf).

    Positions are body-relative already. Speed is per limb, held to ``max_speed``,
    averaged over confident limbs, and the clip's median is taken exactly.
    """
    def build(frame):
        w = frame(None, None)
        return {"_prev": F.lag("limbs").over(w)}

    x = ordered.row_frames(kp, [clip], 1, build)
    pairs = F.filter(F.zip_with("limbs", "_prev", lambda a, b: F.when(
        (a["conf"] > min_conf) & (b["conf"] > min_conf),
        F.least(F.lit(max_speed), F.hypot(a["x"] - b["x"], a["y"] - b["y"]) * fps))), lambda v: v.isNotNull())
    speed = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / F.size(pairs))
    x = x.withColumn("_limb", speed)
    med = exact_quantiles(x, [clip], "_limb", {"limb": 0.5})
    g = x.groupBy(clip).agg(F.count("*").alias("n_frames"), F.avg(F.col("present").cast("int")).alias("person"),
                            F.avg((F.col("_limb") > 0.5).cast("int")).alias("active"))
    return g.join(med, clip, "left").withColumn("limb", F.coalesce("limb", F.lit(0.0)))


def stillness(frames: DataFrame, clip: str, diff: str) -> DataFrame:
    """Median frame difference per clip; 0 with fewer than two differences."""
    q = exact_quantiles(frames, [clip], diff, {"still": 0.5}, count="_n")
    return q.withColumn("still", F.when(F.col("_n") >= 2, F.col("still")).otherwise(0.0)).drop("_n")


def frame_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two luma arrays."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)


def beat_regularity(beats: DataFrame, clip: str, t: str, width_s: float = 3600.0) -> DataFrame:
    """Beats per clip, bpm from the median gap and spread of the gaps over it; clips of at most three beats count as irregular."""
    x = series.indexed(beats.select(clip, t), [clip], t, width_s=width_s)

    def build(frame):
        return {"_gap": F.col(t) - F.lag(t).over(frame(None, None))}

    x = ordered.row_frames(x, [clip], 1, build)
    g = x.groupBy(clip).agg(F.count("*").alias("n_beats"), F.stddev_pop("_gap").alias("_s")).join(
        exact_quantiles(x, [clip], "_gap", {"_m": 0.5}), clip, "left")
    ok = F.col("n_beats") > 3
    return g.select(clip, "n_beats", F.when(ok, F.col("_s") / F.col("_m")).otherwise(9.0).alias("beat_cv"),
                    F.when(ok, 60 / F.col("_m")).otherwise(0.0).alias("bpm"))


def jitter(positions: DataFrame, keys: Sequence[str], joint: str, xyz: Sequence[str], fps: float) -> DataFrame:
    """Frame-step statistics: mean over joints and largest joint, as mean, p90, p99 and worst speed.

    ``positions`` has one row per (keys, joint, idx).
    """
    by = list(keys)

    def build(frame):
        w = frame(None, None)
        return {f"_d{c}": F.col(c) - F.lag(c).over(w) for c in xyz}

    x = ordered.row_frames(positions, [*by, joint], 1, build)
    sq = [F.col(f"_d{c}") * F.col(f"_d{c}") for c in xyz]
    step = F.sqrt(sum(sq[1:], sq[0]))
    per = x.withColumn("_step", step).filter("_step is not null").groupBy(*by, "idx").agg(
        F.avg("_step").alias("mean_step"), F.max("_step").alias("max_step"))
    q = exact_quantiles(per, by, "mean_step", {"mean_p90": 0.9, "mean_p99": 0.99}).join(
        exact_quantiles(per, by, "max_step", {"max_p90": 0.9, "max_p99": 0.99}), by)
    g = per.groupBy(*by).agg(F.avg("mean_step").alias("mean"), F.avg("max_step").alias("max_mean"), F.max("max_step").alias("max_max"))
    return g.withColumn("worst_speed", F.col("max_max") * fps).join(q, by)


def accent_retention(raw: DataFrame, smooth: DataFrame, peaks: DataFrame, keys: Sequence[str], speed: str) -> DataFrame:
    """Share of the raw speed kept at the peak rows: mean and worst per key. All three carry ``idx``."""
    by = list(keys)
    j = peaks.select(*by, "idx").join(raw.select(*by, "idx", F.col(speed).alias("_r")), [*by, "idx"]).join(
        smooth.select(*by, "idx", F.col(speed).alias("_s")), [*by, "idx"])
    kept = F.col("_s") / F.greatest(F.col("_r"), F.lit(1e-9))
    return j.groupBy(*by).agg(F.avg(kept).alias("kept_mean"), F.min(kept).alias("kept_min"), F.count("*").alias("peaks"))


def band_power(df: DataFrame, keys: Sequence[str], value: str, fps: float, low: float = 3.0, high: float = 5.0, run: int = 1024, whole: int = 1 << 20) -> DataFrame:
    """Spectral power at or below ``low`` Hz (without the mean) and at or above ``high``, of each whole series.

    A series of at most ``whole`` samples (a day at 12 a second) is one array and takes one fast
    transform. A longer one is never one task's work: each of its runs of ``run`` samples gives its share
    of every frequency's cosine and sine sum, and the shares meet per (key, frequency); that costs runs
    times frequencies. A series of one sample has no frequency and no power.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"))
    # The mean falls out of every frequency above zero; taken off first, it costs no digits.
    x = df.join(sizes, list(keys)).withColumn("_v", F.col(value).cast("double") - F.col("_m"))

    @F.pandas_udf("struct<low:double,high:double>")
    def transformed(xs: pd.Series) -> pd.DataFrame:
        out = []
        for v in xs:
            power = np.abs(np.fft.rfft(np.asarray(v, dtype=float))) ** 2
            hz = np.arange(len(power)) * fps / len(v)
            out.append((power[1:][hz[1:] <= low].sum(), power[1:][hz[1:] >= high].sum()))
        return pd.DataFrame(out, columns=["low", "high"], dtype=float)

    @F.pandas_udf("array<struct<k:bigint,c:double,s:double>>")
    def shares(xs: pd.Series, first: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, i, size in zip(xs, first, n):
            k = np.arange(1, size // 2 + 1)
            turn = 2 * np.pi / size * (np.outer(k, np.arange(i, i + len(x))) % size)
            v = np.asarray(x, dtype=float)
            out.append([{"k": int(f), "c": float(c), "s": float(s)} for f, c, s in zip(k, np.cos(turn) @ v, np.sin(turn) @ v)])
        return pd.Series(out)

    in_order = F.array_sort(F.collect_list(F.struct("idx", "_v")))
    values = F.transform("_x", lambda r: r["_v"])
    short = x.filter(F.col("_n") <= whole).groupBy(*keys).agg(in_order.alias("_x")).select(*keys, transformed(values).alias("_p")).select(*keys, "_p.*")
    runs = x.filter(F.col("_n") > whole).groupBy(*keys, "_n", F.floor(F.col("idx") / run).alias("_run")).agg(in_order.alias("_x"))
    part = runs.select(*keys, "_n", F.explode(shares(values, F.col("_run") * run, F.col("_n"))).alias("_f"))
    power = part.groupBy(*keys, "_n", F.col("_f.k").alias("_k")).agg((F.pow(F.sum("_f.c"), 2) + F.pow(F.sum("_f.s"), 2)).alias("_p")).withColumn("_hz", F.col("_k") * fps / F.col("_n"))
    long = power.groupBy(*keys).agg(F.sum(F.when(F.col("_hz") <= low, F.col("_p"))).alias("low"), F.sum(F.when(F.col("_hz") >= high, F.col("_p"))).alias("high"))
    return sizes.select(*keys).join(short.unionByName(long), list(keys), "left").fillna(0.0, ["low", "high"])


def suppression_counts(samples: DataFrame, by: str, top: int = 8) -> DataFrame:
    """Suppressed samples per value of ``by`` with their share; the ``top`` most frequent."""
    g = samples.groupBy(by).agg(F.count_if(F.col("suppressed").isNotNull()).alias("n"), F.count("*").alias("_g"))
    every = g.agg(F.sum("_g"))
    return g.select(by, "n", (F.col("n") / every.scalar()).alias("share")).orderBy(F.col("n").desc(), by).limit(top)


def null_distribution(grids: DataFrame, hits: DataFrame, onsets: DataFrame, key: str, t: str, tol_max: float, replicates: int = 200,
                      tol_frac: float = 1 / 16) -> DataFrame:
    """Chance level of fast counts: the hits replayed at shifted offsets, mean and 95th percentile per key.

    Shifts run over 0.1-0.9 counts by the golden-ratio sequence, so a rerun repeats them.
    Shifted hits are made and folded into their counts' positions in the task that reads them; onsets do
    not move, so their positions are found once for all replicates.
    """
    shift = 0.1 + 0.8 * F.pmod(F.col("r") * 0.6180339887498949, F.lit(1.0))
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    on_grid = lambda marks: marks.select(key, t).distinct().join(grids.select(key, "one", "spc"), key)
    h = on_grid(hits).withColumn("r", rep).withColumn(t, F.col(t) + shift * F.col("spc"))
    h = series.count_positions(h, [key, "r"], t, tol_max, tol_frac, "_h")
    o = series.count_positions(on_grid(onsets), [key], t, tol_max, tol_frac, "_o")
    off_beat = F.col("_h").bitwiseAND(F.lit(0b1010)) != 0
    fast = h.filter((F.bit_count("_h") >= 3) & off_beat).join(o.filter(F.bit_count("_o") >= 3), [key, "c"])
    found = fast.groupBy(key, "r").agg(F.count("*").alias("_n"))
    per = grids.select(key).withColumn("r", rep).join(found, [key, "r"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("double"))
    # One number per replicate: the group is the replicate count, whatever the data's size.
    return per.groupBy(key).agg(F.avg("_n").alias("mean"), F.percentile("_n", 0.95).alias("p95"), F.count("*").alias("replicates"))


def zero_shot(frames: DataFrame, prompts: DataFrame, clip: str, vec: str, scale: float = 100.0) -> DataFrame:
    """Softmax share of the positive prompts, averaged over a clip's frames.

    ``prompts`` (prompt vector, positive flag) is a fixed short list; it is packed
    into one value and reaches the frames as a scalar subquery. Unit vectors on both sides.
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def shares(z: Column) -> Column:
        """Positive share of a softmax over (z, pos) entries, shifted by the largest."""
        return let(F.array_max(F.transform(z, lambda q: q["z"])), lambda top: let(
            F.transform(z, lambda q: F.struct(F.exp(q["z"] - top).alias("e"), q["pos"].alias("pos"))),
            lambda e: F.aggregate(e, F.lit(0.0), lambda s, q: s + F.when(q["pos"], q["e"]).otherwise(0.0)) / F.aggregate(e, F.lit(0.0), lambda s, q: s + q["e"])))

    packed = prompts.select("positive", F.col("prompt").alias("p"), F.sqrt(dot(F.col("prompt"), F.col("prompt"))).alias("n")).agg(
        F.collect_list(F.struct("p", "n", "positive")))
    v = F.col(vec)
    logits = let(F.sqrt(dot(v, v)), lambda n: F.transform("_prompts", lambda q: F.struct(
        (scale * dot(v, q["p"]) / (n * q["n"])).alias("z"), q["positive"].alias("pos"))))
    j = frames.withColumn("_prompts", packed.scalar()).withColumn("_share", let(logits, shares))
    return j.groupBy(clip).agg(F.avg("_share").alias("score"), F.count("*").alias("frames"))


def interpolation_error(held_out: DataFrame, kept: DataFrame, keys: Sequence[str], group: str, t: str, value: str, width_s: float) -> DataFrame:
    """Distance between held-out values and their interpolation from kept samples: percentiles per group."""
    x = series.asof_interp(held_out, kept, keys, t, value, width_s).withColumn("_err", F.abs(F.col("interp") - F.col(value)))
    q = exact_quantiles(x, [group], "_err", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return q.join(x.groupBy(group).agg(F.max("_err").alias("max"), F.count("_err").alias("n")), group)


def noise_floor_gap(error: DataFrame, floor: DataFrame, group: str) -> DataFrame:
    """How far an error report sits above its noise floor, per statistic."""
    f = floor.select(group, *[F.col(c).alias(f"_f_{c}") for c in ("median", "p90", "p99", "max")])
    return error.join(f, group).select(group, *[(F.col(c) - F.col(f"_f_{c}")).alias(c) for c in ("median", "p90", "p99", "max")])


def lowest(scored: DataFrame, score: str, name: str, k: int = 4) -> DataFrame:
    """The lowest-scoring rows, ties by name."""
    return scored.select(score, name).orderBy(score, name).limit(k)


def lag_summary(lags: DataFrame, keys: Sequence[str], lag: str) -> DataFrame:
    """Median and quartiles of matched lags."""
    return exact_quantiles(lags, keys, lag, {"median": 0.5, "q1": 0.25, "q3": 0.75}, count="matched")
