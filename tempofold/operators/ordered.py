"""Ordered work on keyed series without ever giving one key to one task.

A window partitioned by the key alone sends the whole history of a hot key to a
single task. These operators split every key into slices first:

* ``dense_index`` numbers rows inside each key from per-slice counts, so a task
  sees one (key, time bucket) at a time.
* ``row_frames`` evaluates bounded row frames on fixed-size runs of that index;
  rows near a run's edge are copied to the neighbouring run (the halo).
* ``carry`` turns unbounded "last value so far" / "running sum" frames into a
  local frame per slice plus one pre-aggregated row per slice.
* ``time_frames`` does the halo trick on a time axis for range frames.

The summary tables these build have one row per (key, slice); a slice is the only
thing a task must hold. Keys and times must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored

RUN_ROWS = 65536
BEFORE = W.unboundedPreceding


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def seconds(ts: Column | str) -> Column:
    """Timestamp to epoch seconds as a double; works for NTZ columns under UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def time_bucket(t: Column | str, width_s: float) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return F.floor(c / F.lit(float(width_s)))


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                idx: str = "idx", size: str | None = None) -> DataFrame:
    """0-based position of each row within its key; ``size`` names the key's row count."""
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(BEFORE, -1)
    starts = per.select(*by, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"),
                        F.sum("_rows").over(W.partitionBy(*keys)).alias("_size"))
    local = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    out = _same_slice(local, starts, by)
    out = out.withColumn(idx, (F.col("_start") + F.col("_rn")).cast("bigint"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_bucket", "_rn", "_start", "_size")


def _same_slice(rows: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join rows with their slice's summary row.

    Plain equality on exactly the window's keys, so the rows are already
    partitioned for it and only the small summary moves. Keys must not be null.
    """
    return rows.join(summary, list(by), "left")


def row_frames(df: DataFrame, keys: Sequence[str], halo: int,
               build: Callable[[Callable[[int, int], W]], Mapping[str, Column]],
               idx: str = "idx", run: int = RUN_ROWS) -> DataFrame:
    """Add columns computed over row frames reaching at most ``halo`` rows either way.

    ``build`` gets ``frame(lo, hi)`` (a window spec) and returns name -> column;
    ``frame(None, None)`` is the bare ordered spec for lag and lead.
    """
    spread, spec = spread_runs(df, keys, halo, idx, run)

    def frame(lo: int | None, hi: int | None):
        return spec if lo is None else spec.rowsBetween(lo, hi)

    return keep_home(spread.withColumns(dict(build(frame))), idx, run)


def spread_runs(df: DataFrame, keys: Sequence[str], halo: int, idx: str = "idx", run: int = RUN_ROWS) -> tuple[DataFrame, W]:
    """Rows copied to every run within ``halo`` of them, and the ordered window of one run.

    For work in several window steps: they share the window, so they share one
    shuffle; ``halo`` must cover their reaches together. End with ``keep_home``.
    """
    if halo > run:
        raise ValueError("halo must fit inside one run")
    home = F.floor(F.col(idx) / F.lit(run))
    near = F.array_distinct(F.array(F.floor((F.col(idx) - halo) / F.lit(run)), home,
                                    F.floor((F.col(idx) + halo) / F.lit(run))))
    return df.withColumn("_run", F.explode(near)).filter("_run >= 0"), W.partitionBy(*keys, "_run").orderBy(idx)


def keep_home(df: DataFrame, idx: str = "idx", run: int = RUN_ROWS) -> DataFrame:
    return df.filter(F.col("_run") == F.floor(F.col(idx) / F.lit(run))).drop("_run")


def time_frames(df: DataFrame, keys: Sequence[str], t: str, halo_s: float, width_s: float,
                build: Callable[[Callable[[float, float], W]], Mapping[str, Column]],
                scale: int = 1_000_000) -> DataFrame:
    """``row_frames`` on a time axis: frames given in seconds, halo of ``halo_s``."""
    width_s = max(width_s, halo_s)
    home = F.floor(F.col(t) / F.lit(width_s))
    near = F.array_distinct(F.array(F.floor((F.col(t) - halo_s) / F.lit(width_s)), home,
                                    F.floor((F.col(t) + halo_s) / F.lit(width_s))))
    spread = (df.withColumn("_slot", F.explode(near))
              .withColumn("_ticks", F.round(F.col(t) * scale).cast("bigint")))
    spec = W.partitionBy(*keys, "_slot").orderBy("_ticks")

    def frame(lo: float, hi: float):
        return spec.rangeBetween(int(round(lo * scale)), int(round(hi * scale)))

    made = build(frame)
    return spread.withColumns(dict(made)).filter(F.col("_slot") == home).drop("_slot", "_ticks")


def along(order: Sequence[str], ahead: bool) -> list[Column]:
    """The order, or for looks ``ahead`` its exact reverse, in which they look back.

    A frame that ends at unbounded following is read to its end for every row, so a slice would cost
    the square of its rows; one from unbounded preceding is read once.
    """
    return [F.col(c).desc() if ahead else F.col(c).asc() for c in order]


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
               values: Mapping[str, Column], ahead: bool = False, strict: bool = False) -> DataFrame:
    """Last non-null value at or before each row (first at or after when ``ahead``).

    ``values`` maps output name -> source column. ``strict`` excludes the row itself.
    """
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    place = F.struct(*cols(order))
    pick = F.min_by if ahead else F.max_by
    per = df.groupBy(*by).agg(*[
        pick(F.when(src.isNotNull(), src), F.when(src.isNotNull(), place)).alias(f"_s_{name}")
        for name, src in values.items()])
    slices = W.partitionBy(*keys).orderBy(*along(["_bucket"], ahead)).rowsBetween(BEFORE, -1)
    summary = per.select(*by, *[F.last(f"_s_{name}", ignorenulls=True).over(slices).alias(f"_c_{name}")
                                for name in values])
    rows = W.partitionBy(*by).orderBy(*along(order, ahead)).rowsBetween(BEFORE, -1 if strict else 0)
    local = df.withColumns({f"_l_{name}": F.last(src, ignorenulls=True).over(rows)
                            for name, src in values.items()})
    out = _same_slice(local, summary, by)
    out = out.withColumns({name: F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name in values})
    return out.drop("_bucket", *[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])


def carry_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, src: Column,
               back: str = "_back", ahead: str = "_ahead") -> DataFrame:
    """Nearest non-null value at or before and at or after each row, in one shuffle of the rows."""
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    place = F.when(src.isNotNull(), F.struct(*cols(order)))
    value = F.when(src.isNotNull(), src)
    per = df.groupBy(*by).agg(F.max_by(value, place).alias("_sb"), F.min_by(value, place).alias("_sa"))
    slices = lambda ahead: W.partitionBy(*keys).orderBy(*along(["_bucket"], ahead)).rowsBetween(BEFORE, -1)
    summary = per.select(*by, F.last("_sb", ignorenulls=True).over(slices(False)).alias("_cb"),
                         F.last("_sa", ignorenulls=True).over(slices(True)).alias("_ca"))
    rows = lambda ahead: W.partitionBy(*by).orderBy(*along(order, ahead)).rowsBetween(BEFORE, 0)
    local = df.withColumns({"_lb": F.last(src, ignorenulls=True).over(rows(False)),
                            "_la": F.last(src, ignorenulls=True).over(rows(True))})
    out = _same_slice(local, summary, by)
    return out.withColumn(back, F.coalesce("_lb", "_cb")).withColumn(ahead, F.coalesce("_la", "_ca")).drop(
        "_bucket", "_lb", "_cb", "_la", "_ca")


def max_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, src: Column,
             back: str = "_back", ahead: str = "_ahead") -> DataFrame:
    """Greatest value strictly before and strictly after each row of its key, in one shuffle of the rows."""
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    per = df.groupBy(*by).agg(F.max(src).alias("_sm"))
    slices = lambda ahead: W.partitionBy(*keys).orderBy(*along(["_bucket"], ahead)).rowsBetween(BEFORE, -1)
    summary = per.select(*by, F.max("_sm").over(slices(False)).alias("_cb"), F.max("_sm").over(slices(True)).alias("_ca"))
    rows = lambda ahead: W.partitionBy(*by).orderBy(*along(order, ahead)).rowsBetween(BEFORE, -1)
    local = df.withColumns({"_lb": F.max(src).over(rows(False)), "_la": F.max(src).over(rows(True))})
    out = _same_slice(local, summary, by)
    return out.withColumn(back, F.greatest("_lb", "_cb")).withColumn(ahead, F.greatest("_la", "_ca")).drop(
        "_bucket", "_lb", "_cb", "_la", "_ca")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                values: Mapping[str, Column]) -> DataFrame:
    """Running sum up to and including each row, one output column per entry."""
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    per = df.groupBy(*by).agg(*[F.sum(src).alias(f"_s_{n}") for n, src in values.items()])
    ahead = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(BEFORE, -1)
    summary = per.select(*by, *[F.sum(f"_s_{n}").over(ahead).alias(f"_c_{n}") for n in values])
    rows = W.partitionBy(*by).orderBy(*order).rowsBetween(BEFORE, 0)
    local = df.withColumns({f"_l_{n}": F.sum(src).over(rows) for n, src in values.items()})
    out = _same_slice(local, summary, by)
    out = out.withColumns({n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
                           for n in values})
    return out.drop("_bucket", *[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])


def index_bucket(idx: str = "idx", run: int = RUN_ROWS) -> Column:
    return F.floor(F.col(idx) / F.lit(run))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str],
         width_s: float, ahead: bool = False, allow_equal: bool = True, tie: Sequence[str] = (),
         out: str = "hit") -> DataFrame:
    """Attach to each left row the nearest right row before (or ``ahead``) in time.

    Both sides have ``keys`` and a double ``t``. The match arrives as one struct
    column ``out`` with ``t`` and the payload, null when there is none. Several
    right rows at one time: the last in ``tie`` order (the first when ``ahead``).
    """
    hit = F.struct(F.col(t).alias("t"), *cols(payload))
    row = F.struct(*cols(left.columns))
    # Right rows sort before left rows at equal t when looking back with equality.
    right_side = 0 if (allow_equal != ahead) else 1
    pad = [F.lit(None).cast(dict(right.dtypes)[c]).alias(f"_tie{i}") for i, c in enumerate(tie)]
    a = left.select(*cols(keys), F.col(t).alias("_t"), F.lit(1 - right_side).alias("_side"),
                    *pad, row.alias("_row"))
    b = right.select(*cols(keys), F.col(t).alias("_t"), F.lit(right_side).alias("_side"),
                     *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], hit.alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    done = carry_last(both, keys, order, time_bucket("_t", width_s), {out: F.col("_hit")}, ahead=ahead)
    return done.filter(F.col("_row").isNotNull()).select("_row.*", out)


def asof_both(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str], width_s: float,
              equal: str = "back", tie: Sequence[str] = ()) -> DataFrame:
    """``asof`` in both directions at once: structs ``_back`` and ``_ahead``.

    A right row at exactly the left row's time counts on the ``equal`` side only.
    """
    hit = F.struct(F.col(t).alias("t"), *cols(payload))
    right_side = 0 if equal == "back" else 1
    ties = [f"_tie{i}" for i in range(len(tie))]
    kinds = dict(right.dtypes)
    a = left.select(*cols(keys), F.col(t).alias("_t"), F.lit(1 - right_side).alias("_side"),
                    *[F.lit(None).cast(kinds[c]).alias(n) for c, n in zip(tie, ties)], F.struct(*cols(left.columns)).alias("_row"))
    b = right.select(*cols(keys), F.col(t).alias("_t"), F.lit(right_side).alias("_side"),
                     *[F.col(c).alias(n) for c, n in zip(tie, ties)], hit.alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    done = carry_both(both, keys, ["_t", "_side", *ties], time_bucket("_t", width_s), F.col("_hit"))
    return done.filter(F.col("_row").isNotNull()).select("_row.*", "_back", "_ahead")


def band_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str,
               tol: float | Column, tol_max: float) -> DataFrame:
    """Inner join on keys and |lt - rt| <= tol by cell equi-join; ``tol`` never exceeds ``tol_max``.

    Left rows visit three cells, right rows one, so each pair meets at most once.
    """
    tol = tol if isinstance(tol, Column) else F.lit(float(tol))
    cell = F.floor(F.col(lt) / F.lit(tol_max)).cast("bigint")
    a = left.withColumn("_cell", F.explode(F.sequence(cell - 1, cell + 1)))
    b = right.withColumn("_cell", F.floor(F.col(rt) / F.lit(tol_max)).cast("bigint"))
    return a.join(b, [*keys, "_cell"]).filter(F.abs(F.col(lt) - F.col(rt)) <= tol).drop("_cell")


def sessions(df: DataFrame, keys: Sequence[str], t: str, tie: Sequence[str], gap_s: float,
             width_s: float) -> DataFrame:
    """Number the runs of rows whose gaps are at most ``gap_s``; adds ``session``."""
    order = [t, *tie]
    prev = carry_last(df, keys, order, time_bucket(t, width_s), {"_prev": F.col(t)}, strict=True)
    flag = F.when(F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > gap_s), 1).otherwise(0)
    return running_sum(prev, keys, order, time_bucket(t, width_s), {"session": flag}).drop("_prev")


def reachable(nodes: DataFrame, keys: Sequence[str], at: str, after: str, start: str) -> DataFrame:
    """(keys, at) of the nodes that chains of pointers from the ``start`` nodes pass through.

    ``nodes``: keys, ``at`` (one row each within a key), ``after`` (a later ``at``, or null at a chain's
    end) and a boolean ``start``. Pointers double in reach each round, so a chain of n nodes takes
    log2(n) rounds, and every join is on (key, node): a key's chain is never one task's work.
    """
    by = [*keys, at]
    reached = stored(nodes.filter(start).select(*by), "chain-reached")
    jumps = stored(nodes.filter(F.col(after).isNotNull()).select(*by, after), "chain-jumps")
    while True:
        ahead = reached.join(jumps, by).select(*keys, F.col(after).alias(at)).distinct().join(reached, by, "left_anti")
        ahead = stored(ahead, "chain-ahead")
        if ahead.isEmpty():
            return reached
        reached = reached.unionByName(ahead)
        further = jumps.select(*keys, F.col(at).alias(after), F.col(after).alias("_further"))
        jumps = stored(jumps.join(further, [*keys, after]).select(*by, F.col("_further").alias(after)), "chain-jumps")
