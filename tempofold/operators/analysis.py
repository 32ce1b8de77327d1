"""The whole analysis of a dance: where it is, evidence at every quarter, nested cuts, described steps.

Samples are numbered once into a table that every later step reads; grid positions
are scored once, whatever the levels. Each level cuts inside the steps of the one
before it, at its own price, and inherits their chunks. A clip's samples are
spread over tasks throughout; only its quarters meet, one parent step at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import counts as C
from ..session import stored
from . import motion, ordered, series
from .quantiles import exact_quantiles


def dance_span(counts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, q_start, q_end) in quarters, and the idle spans in counts (from, to, kind, why), of counts with c and why."""
    numbered = ordered.dense_index(counts.withColumn("c1", F.col("c") + 1), [key], ["c"], F.floor(F.col("c") / ordered.RUN_ROWS), size="n")
    idle = series.idle_spans(numbered, [key], t0="c", t1="c1")
    edges = idle.groupBy(key).agg(F.max(F.when(F.col("kind") == "lead-in", F.col("t1"))).alias("_lead"), F.min(F.when(F.col("kind") == "outro", F.col("t0"))).alias("_out"))
    # From the first count after the lead-in to the last before the outro; a clip idle throughout is kept whole.
    g = counts.join(edges, key, "left").groupBy(key).agg(F.min(F.when(F.col("c") >= F.coalesce("_lead", "c"), F.col("c"))).alias("_from"), F.max(F.when(F.col("c") < F.coalesce("_out", F.col("c") + 1), F.col("c"))).alias("_to"),
                                                         F.min("c").alias("_first"), F.max("c").alias("_last"))
    span = g.select(key, (4 * F.coalesce("_from", "_first")).alias("q_start"), (4 * (F.when(F.col("_from").isNull(), F.col("_last")).otherwise(F.col("_to")) + 1)).alias("q_end"))
    return span, idle.withColumnsRenamed({"t0": "from", "t1": "to"})


def cut_cues(samples: DataFrame, key: str, components: Sequence[str]) -> DataFrame:
    """Samples (with idx, n, spc) with ``cue``: the stronger of a stop of the energy and a turn of the velocity."""
    spacing = exact_quantiles(ordered.row_frames(samples, [key], 1, lambda frame: {"_dt": F.col("t") - F.lag("t").over(frame(None, None))}), [key], "_dt", {"_mdt": 0.5})
    speed = F.sqrt(sum((F.col(c) * F.col(c) for c in components), F.lit(0.0)))
    typical = exact_quantiles(samples.filter("ok").withColumn("_v", speed), [key], "_v", {"_med": 0.5})
    x = samples.join(spacing, key, "left").join(typical, key, "left")
    # Half a count of rows either side, as many as the clip's rate makes of it; the whole clip (0) where most samples share a moment or half a count is longer.
    rows = F.bround(F.col("spc") / 2 / F.nullif(F.col("_mdt"), F.lit(0.0)))
    whole = (F.col("_mdt") == 0) | ((rows >= ordered.RUN_ROWS) & (rows >= F.col("n")))
    x = stored(x.withColumn("_w", F.when(whole, 0).otherwise(F.greatest(F.lit(2), F.coalesce(rows, F.lit(2.0)).cast("int")))), "analysis-rates")
    parts = [series.stop_cue(x.filter(F.col("_w") == r[0]), [key], "energy", int(r[0]) or None, ok=F.col("ok")) for r in x.select("_w").distinct().collect()]  # sample rates are few
    if not parts:
        return x.withColumn("cue", F.lit(0.0)).drop("_w", "_med", "_mdt")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    both = series.turn_cue(both, [key], components, F.coalesce("_med", F.lit(0.0)) + 1e-6, ok=F.col("ok"))
    return both.withColumn("cue", F.greatest("stop", "turn")).drop("_w", "_med", "_mdt", "stop", "turn")


def _described(steps: DataFrame, samples: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Steps with mean energy, peakiness, the cue at their end and how far off the grid it lies.

    Samples meet steps on quarters; one exactly between two steps counts for both.
    """
    quarter = (F.col("t") - F.col("one")) / (F.col("spc") / 4)
    at = F.floor(quarter)
    spread = samples.select(key, "idx", "energy", F.explode(F.when(quarter == at, F.array(at, at - 1)).otherwise(F.array(at))).alias("q"))
    quarters = steps.select(key, "step", F.explode(F.sequence("a", F.col("b") - 1)).alias("q"))
    inside = spread.join(quarters, [key, "q"]).dropDuplicates([key, "step", "idx"])
    # Summed in the order of time: steps with the same samples then have the same mean to the last bit, and compare so with the quantiles.
    upto = W.partitionBy(key, "step").orderBy("idx").rowsBetween(ordered.BEFORE, 0)
    mean = F.max_by("_upto", "idx") / F.nullif(F.count("energy"), F.lit(0))
    g = inside.withColumn("_upto", F.sum("energy").over(upto)).groupBy(key, "step").agg(F.count("*").alias("samples"), mean.alias("mean_energy"), F.max("energy").alias("_top"))
    out = steps.join(g, [key, "step"], "left").withColumn("peakiness", F.col("_top") / (F.col("mean_energy") + 1e-6))
    ends = scores.select(key, F.col("q").alias("b"), F.col("score").alias("end_cue"), F.col("offset").alias("end_offset"))
    out = out.join(ends, [key, "b"], "left").withColumn("end_cue", F.coalesce("end_cue", F.lit(0.0))).drop("_top")
    return out.withColumn("samples", F.coalesce("samples", F.lit(0)))


def analyse(samples: DataFrame, grids: DataFrame, key: str, components: Sequence[str], envelope: DataFrame | None = None, fast: DataFrame | None = None, music: DataFrame | None = None,
            width_s: float = 3600.0, accent_reach: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """(steps of all levels, idle spans).

    ``samples``: key, t, ok, energy, limb, root, music (unless given apart) and velocity components;
    ``grids``: key, one, spc, bpm, one row a clip; ``envelope``: key, t, env; ``fast``: key, q, the
    quarters with sub-beat evidence. Steps have level, step, parent (a step of the level before), chunk,
    a and b (quarters from count 1), ta and tb, samples, mean_energy, peakiness, quality, end_cue,
    end_offset and sub_beat. Keys, times and grids must not be null; clips without a grid are left out.
    """
    s = stored(series.indexed(samples.join(grids, key), [key], "t", width_s=width_s, size="n"), "analysis-samples")
    counts = motion.counts_motion(s, key, F.col("one"), F.col("spc"), music, width_s, lock=False)
    span, idle = dance_span(stored(counts.select(key, "c", "why"), "analysis-counts"), key)
    span = stored(span.join(grids, key), "analysis-spans")
    cues = cut_cues(s, key, components)
    positions = span.select(key, "one", "spc", F.explode(F.sequence("q_start", "q_end")).alias("q")).withColumn("at", F.col("one") + F.col("q") * F.col("spc") / 4).withColumn("level", C.metrical(F.col("q")))
    if fast is None:
        positions = positions.withColumn("fast", F.lit(False))
    else:
        marks = fast.select(key, "q").distinct().withColumn("fast", F.lit(True))
        positions = positions.join(marks, [key, "q"], "left").withColumn("fast", F.coalesce("fast", F.lit(False)))
    # Written out: a plan takes spans laid out in quarters to be as small as the spans, and would broadcast them.
    positions = stored(positions, "analysis-positions")
    widest = grids.agg(F.max("spc")).first()[0] or 1.0
    reach = F.when(F.col("level") < 3, F.col("spc") / 4).otherwise(F.col("spc") / 8)
    scored = series.grid_score(positions, cues, envelope, key, "t", reach, widest / 4, accent_reach=accent_reach)
    scores = stored(scored.select(key, "q", "level", "fast", "score", "offset"), "analysis-scores")

    parents = span.select(key, F.lit(0).cast("bigint").alias("parent"), F.col("q_start").alias("a"), F.col("q_end").alias("b"), "spc", "bpm").filter("a < b")
    levels, above = [], None
    for level in motion.LEVELS:
        cut = motion.segment(parents, scores, key, level)
        steps = ordered.dense_index(cut, [key], ["a"], F.floor(F.col("a") / ordered.RUN_ROWS), idx="step")
        if above is None:
            steps = steps.withColumn("parent", F.lit(None).cast("bigint")).join(motion.chunks(steps, key), [key, "a", "b"])
        else:
            steps = steps.join(above.select(key, F.col("step").alias("parent"), "chunk"), [key, "parent"])
        steps = _described(steps, s, scores, key).join(grids, key)
        at = lambda q: F.col("one") + F.col(q) * F.col("spc") / 4
        third = lambda q: C.metrical(F.col(q)) == 3
        steps = steps.select(key, F.lit(level).alias("level"), "step", "parent", "chunk", "a", "b", at("a").alias("ta"), at("b").alias("tb"), "samples", "mean_energy", "peakiness", "end_cue", "end_offset",
                             (third("a") | third("b")).alias("sub_beat"))
        above = stored(steps, "analysis-steps")
        parents = above.select(key, F.col("step").alias("parent"), "a", "b").join(grids.select(key, "spc", "bpm"), key)
        levels.append(above)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return motion.label_quality(out, [key, "level"], keep=True), idle
