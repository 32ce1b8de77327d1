"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here a
monotone logarithmic binning finds, from map-side counts alone, which bins hold
the wanted ranks; only those bins are read again and each is ranked on its own
distinct values. The answers are exact and interpolate linearly between ranks.
Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import BEFORE, cols

BINS_PER_OCTAVE = 64


def value_bin(v: Column) -> Column:
    """Order-preserving integer bin of a double (zero gets its own bin)."""
    size = F.floor(F.log2(F.abs(v)) * BINS_PER_OCTAVE).cast("bigint") + F.lit(2_000_000)
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.signum(v).cast("bigint") * size)


def between(lo: Column, hi: Column, frac: Column) -> Column:
    """lo * (1 - frac) + hi * frac with one rounding of the first product and the sum, as SQL's quantile_cont has it.

    Values are compared with their group's quantile, so the last bit tells; the product's rounding error
    comes from its factors' halves, the sum's from its terms.
    """
    rest, s = 1 - frac, hi * frac
    p = lo * rest

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * 134217729.0
        top = big - (big - x)
        return top, x - top

    (ah, al), (bh, bl) = halves(lo), halves(rest)
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    t = p + s
    z = t - p
    exact = t + (((p - (t - z)) + (s - z)) + lost)
    return F.when(frac == 0, lo).when(F.isnan(exact), p + s).otherwise(exact)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float],
                    count: str | None = None) -> DataFrame:
    """One row per key with a column per named quantile (numpy's linear rule)."""
    by = list(keys)
    src = df.select(*cols(by), F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    src = src.withColumn("_bin", value_bin(F.col("_v")))
    bins = src.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*by).orderBy("_bin").rowsBetween(BEFORE, 0)
    bins = (bins.withColumn("_hi", F.sum("_n").over(upto))
            .withColumn("_lo", F.col("_hi") - F.col("_n"))
            .withColumn("_all", F.sum("_n").over(W.partitionBy(*by))))
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p")) for name, p in qs.items()])
    h = F.col("_w.p") * (F.col("_all") - 1)
    ranks = (bins.withColumn("_w", F.explode(wanted))
             .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("_rank", F.when(F.col("_side") == 0, F.floor(h)).otherwise(F.ceil(h)).cast("bigint"))
             .filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
             .select(*cols(by), "_bin", "_all", F.col("_w.q").alias("_q"), "_side",
                     (F.col("_rank") - F.col("_lo")).alias("_at"), (h - F.floor(h)).alias("_frac")))
    # One row per wanted bin carries its list of ranks, so values meet each bin once.
    asks = ranks.groupBy(*by, "_bin").agg(
        F.collect_list(F.struct("_q", "_side", "_at", "_frac", "_all")).alias("_asks"))
    pairs = [*by, "_bin"]
    hit = src.join(asks.select(*pairs), pairs, "left_semi")
    vals = hit.groupBy(*pairs, "_v").agg(F.count(F.lit(1)).alias("_n"))
    inbin = W.partitionBy(*pairs).orderBy("_v").rowsBetween(BEFORE, 0)
    vals = vals.withColumn("_vhi", F.sum("_n").over(inbin)).withColumn("_vlo", F.col("_vhi") - F.col("_n"))
    got = (vals.join(asks, pairs)
           .withColumn("_a", F.explode("_asks"))
           .filter((F.col("_a._at") >= F.col("_vlo")) & (F.col("_a._at") < F.col("_vhi"))))
    part = {(name, side): F.max(F.when((F.col("_a._q") == name) & (F.col("_a._side") == side), F.col("_v")))
            for name in qs for side in (0, 1)}
    frac = {name: F.max(F.when(F.col("_a._q") == name, F.col("_a._frac"))) for name in qs}
    out = got.groupBy(*by).agg(
        *[c.alias(f"_lo_{n}" if side == 0 else f"_hi_{n}") for (n, side), c in part.items()], *[c.alias(f"_f_{n}") for n, c in frac.items()],
        *([F.max("_a._all").alias(count)] if count else []))
    return out.select(*cols(by), *[between(F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_f_{n}")).alias(n) for n in qs], *([count] if count else []))
