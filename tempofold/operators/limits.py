"""Limits in which refused rows do not count, replayed over a log of any size.

The dispatch limiter is one rule over all addresses: everybody together, then an
address's day, then its hour, and a refusal by any of them counts for none. Every
decision hangs on the ones before it, but only through the rows accepted in the
last day, and the limits themselves keep those few. So the log is cut by counts
into slices in time order; a slice is replayed from the accepted rows that reach
into it, and what it accepts goes to the slices after it. All slices start at once
from a guess (nothing accepted before them); those whose incoming rows turn out
different run again, until none does. After a quiet day a slice depends on nothing,
and the first slice that is not settled settles in every round.

Where everybody's limit is reached day after day, that is one slice a round. So the rounds
go over spans of several slices, and only look for accepted rows: these are few, and between
two of them an address leaps over the attempts that its own or everybody's limit refuses.
Codes and waits are told slice by slice at the end.
"""

from __future__ import annotations

import bisect
import functools
import heapq
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stored
from . import ordered
from .events import GLOBAL_DAY, IP_DAY, IP_HOUR, MIN_WAIT_S, REMOVALS_DAY

# The codes told to a refused client.
EVERYBODY, ADDRESS, REMOVALS = "daily_limit_reached", "too_many_lessons", "too_many_removals"
HOUR, DAY = 3_600_000_000, 86_400_000_000
SLICE_ROWS, SPAN_SLICES = 200_000, 10
HELD = "array<struct<at:bigint,address:string>>"


def decide(at: list[int], address: list, held: list[tuple[int, str]], hour: int, day: int, everybody: int) -> tuple[list[bool], list[str | None], list[int | None]]:
    """Decisions on attempts in order (microseconds), after the ``held`` accepted ones; constant work an attempt."""
    everyone: deque[int] = deque()
    own: dict = {}

    def accept(now, who):
        everyone.append(now)
        today, times = own.get(who, (None, None))
        if today != now // DAY:  # the address's hash changes at midnight
            times = []
            own[who] = (now // DAY, times)
        times.append(now)

    def wait(free, now):
        return max(MIN_WAIT_S, (free - now) // 1_000_000)

    for row in held:
        accept(*row)
    flags, codes, waits = [], [], []
    for now, who in zip(at, address):
        while everyone and everyone[0] <= now - DAY:
            everyone.popleft()
        today, times = own.get(who, (None, ()))
        if today != now // DAY:
            times = ()
        midnight = (now // DAY + 1) * DAY
        code = left = None
        if len(everyone) >= everybody:
            code, left = EVERYBODY, wait((everyone[0] if everyone else now) + DAY, now)
        elif len(times) >= day:
            code, left = ADDRESS, wait(min((times[0] if times else now) + DAY, midnight), now)
        else:
            recent = bisect.bisect_right(times, now - HOUR)
            if len(times) - recent >= hour:
                code, left = ADDRESS, wait(min((times[recent] if recent < len(times) else now) + HOUR, midnight), now)
        if code is None:
            accept(now, who)
        flags.append(code is None)
        codes.append(code)
        waits.append(left)
    return flags, codes, waits


def accepted_places(at: np.ndarray, address: pa.Array, held: list[tuple[int, str]], hour: int, day: int, everybody: int) -> list[int]:
    """Places of the accepted attempts, as ``decide`` has them; refused ones are leapt over where an address makes many.

    Every address waits at its first attempt that its own limits allow. The earliest of these is accepted,
    or moves to the address's first attempt after somebody leaves everybody's day.
    """
    if not len(at) or min(hour, day, everybody) <= 0:
        return []
    coded = pa.array(address).dictionary_encode(null_encoding="encode")
    names, who = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    by_who = np.argsort(who, kind="stable")
    times_of, ends = at[by_who], np.cumsum(np.bincount(who, minlength=len(names))).tolist()
    everyone: deque[int] = deque()
    own: dict = {}

    def accept(now, name):
        everyone.append(now)
        today, times = own.get(name, (None, None))
        if today != now // DAY:
            times = []
            own[name] = (now // DAY, times)
        times.append(now)

    def leap(w, k, target):
        return k + int(np.searchsorted(times_of[k:ends[w]], target))

    def allowed(w, k):
        while k < ends[w]:
            now = int(times_of[k])
            today, times = own.get(names[w], (None, ()))
            if today != now // DAY or len(times) < hour:
                if today != now // DAY or len(times) < day:
                    return k
            midnight = (now // DAY + 1) * DAY
            if len(times) >= day:
                k = leap(w, k, midnight)
            elif times[-hour] + HOUR > now:
                k = leap(w, k, min(times[-hour] + HOUR, midnight))
            else:
                return k
        return None

    def wait_at(w, k):
        k = allowed(w, k)
        if k is not None:
            heapq.heappush(waiting, (int(by_who[k]), w, k))

    for row in held:
        accept(*row)
    waiting: list[tuple[int, int, int]] = []
    for w, begin in enumerate([0, *ends[:-1]]):
        wait_at(w, begin)
    places = []
    while waiting:
        place, w, k = heapq.heappop(waiting)
        now = int(at[place])
        while everyone and everyone[0] <= now - DAY:
            everyone.popleft()
        if len(everyone) >= everybody:
            wait_at(w, leap(w, k, everyone[-everybody] + DAY))
        else:
            accept(now, names[w])
            places.append(place)
            wait_at(w, k + 1)
    return places


def _slice(rows: pa.Table, state: pa.Table, address: str, tie: list[str], only_accepted: bool, limits: tuple[int, int, int]) -> pa.Table:
    rows = rows.sort_by([("_at", "ascending"), *((c, "ascending") for c in tie)])
    held = [(h["at"], h["address"]) for h in state["held"][0].as_py()] if state.num_rows else []
    if only_accepted:
        places = accepted_places(rows["_at"].to_numpy(), rows["_who"].combine_chunks(), held, *limits)
        return rows.take(pa.array(places, pa.int64())).select(["_slice", "_at", "_who", "_part"])
    flags, codes, waits = decide(rows["_at"].to_pylist(), rows["_who"].to_pylist(), held, *limits)
    return rows.drop_columns(["_slice", "_at", "_who"]).append_column("accepted", pa.array(flags, pa.bool_())).append_column("code", pa.array(codes, pa.string())).append_column("wait_s", pa.array(waits, pa.int64()))


def _incoming(accepted: DataFrame, spans: DataFrame) -> DataFrame:
    """slice, held: the accepted rows of earlier slices that lie less than a day before a slice's first row.

    Rows meet slices by day: a row counts for slices that begin on its day or on the next one.
    """
    cell = F.floor(F.col("_at") / DAY)
    reach = accepted.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    met = reach.join(spans.withColumn("cell", F.floor(F.col("first") / DAY)), "cell").where((F.col("_slice") < F.col("slice")) & (F.col("_at") > F.col("first") - DAY))
    return met.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_who").alias("address")))).alias("held"))


def replay(rows: DataFrame, address: str, t: str, tie: list[str], hour: int = IP_HOUR, day: int = IP_DAY, everybody: int = GLOBAL_DAY, before: DataFrame | None = None, slice_rows: int = SLICE_ROWS, span_slices: int = SPAN_SLICES) -> DataFrame:
    """``rows`` with accepted, code and wait_s (seconds, null where accepted).

    ``t`` is in seconds; ``tie`` orders attempts of one time. An address counts within its UTC day only,
    since its hash changes at midnight; everybody counts over 24 hours. ``before`` has the accepted
    attempts so far (address, t). Rounds go over spans of ``span_slices`` slices. A null address is an address; a null time is not allowed.
    """
    if everybody < 0 or day < 0 or hour < 0:
        raise ValueError("limits are counts")
    limits = (hour, day, everybody)
    timed = rows.withColumn("_at", F.round(F.col(t) * 1_000_000).cast("bigint")).withColumn("_who", F.col(address).cast("string"))
    n = timed.count()
    placed = timed.repartitionByRange(max(1, -(-n // slice_rows)), "_at", *tie).withColumn("_slice", F.spark_partition_id())
    placed = stored(placed, "limit-slices")
    begins = lambda df: df.groupBy(F.col("_slice").alias("slice")).agg(F.min("_at").alias("first"))
    narrow = placed.select(F.floor(F.col("_slice") / span_slices).cast("int").alias("_slice"), "_at", "_who", F.col("_slice").alias("_part"), *tie)
    spans = stored(begins(narrow), "limit-spans")
    past = None if before is None else before.select(F.lit(-1).alias("_slice"), F.round(F.col(t) * 1_000_000).cast("bigint").alias("_at"), F.col(address).cast("string").alias("_who"), F.lit(-1).alias("_part"))
    schema = T.StructType([narrow.schema[c] for c in ("_slice", "_at", "_who", "_part")])

    def run(part: DataFrame, states: DataFrame, only_accepted: bool, out) -> DataFrame:
        fold = functools.partial(_slice, address=address, tie=list(tie), only_accepted=only_accepted, limits=limits)
        return part.groupBy("_slice").cogroup(states.groupBy("slice")).applyInArrow(lambda a, b: fold(a, b), out)

    states = stored(_incoming(past, spans) if past is not None else spans.sparkSession.createDataFrame([], f"slice int, held {HELD}"), "limit-states")
    accepted = stored(run(narrow, states, True, schema), "limit-accepted")
    while True:
        new = stored(_incoming(accepted if past is None else accepted.unionByName(past), spans), "limit-states")
        old = states.withColumnRenamed("held", "was")
        changed = stored(new.join(old, "slice", "full").where(~F.col("held").eqNullSafe(F.col("was"))).select("slice"), "limit-changed")
        states = new
        if changed.isEmpty():
            break
        again = F.col("_slice") == F.col("slice")
        redone = run(narrow.join(changed, again, "left_semi"), states.join(changed, "slice", "left_semi"), True, schema)
        accepted = stored(accepted.join(changed, again, "left_anti").unionByName(redone), "limit-accepted")
    known = (accepted if past is None else accepted.unionByName(past)).withColumn("_slice", F.col("_part"))
    states = _incoming(known, begins(placed))
    out = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("code", T.StringType()), T.StructField("wait_s", T.LongType())])
    return run(placed, states, False, out).select(*rows.columns, "accepted", "code", "wait_s")


def removals(rows: DataFrame, address: str, t: str, tie: list[str], cap: int = REMOVALS_DAY, width_s: float = 3600.0) -> DataFrame:
    """``rows`` with accepted, code and wait_s: an address may take down ``cap`` lessons a UTC day.

    The count begins anew at midnight and nothing leaves it before, so the first ``cap`` of a day stand
    and no replay is needed. ``address`` and ``t`` (seconds) must not be null.
    """
    daily = rows.withColumn("_day", F.floor(F.col(t) / 86400))
    placed = ordered.dense_index(daily, [address, "_day"], [t, *tie], ordered.time_bucket(t, width_s), idx="_n")
    refused = F.col("_n") >= cap
    left = F.greatest(F.lit(MIN_WAIT_S).cast("bigint"), F.floor((F.col("_day") + 1) * 86400 - F.col(t)).cast("bigint"))
    return placed.select(*rows.columns, (~refused).alias("accepted"), F.when(refused, REMOVALS).alias("code"), F.when(refused, left).alias("wait_s"))
