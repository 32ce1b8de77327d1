"""Keyed state processors. State per key is a few numbers, one window's accepted times, or the numbers of a part of the keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


def _in_order(rows: Iterator[pd.DataFrame], t: str) -> pd.DataFrame:
    """One key's rows of one micro-batch, in time order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(t, kind="stable")


class DailyCap(StatefulProcessor):
    """Keep the first ``cap`` rows per visitor and day number; a new day is a new key and starts at zero.

    A key is (day, part): a part of the visitors, whose counts are one value. A call of the state costs
    far more than a row, so keys are few and their rows are counted together.
    """

    def __init__(self, cap: int, columns: list[str], visitor: T.DataType, t: str = "t"):
        self.cap, self.columns, self.visitor, self.t = cap, columns, visitor, t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("visitors", T.ArrayType(self.visitor)), T.StructField("n", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            seen = dict(zip(*self.seen.get()))
        else:
            seen = {}
            # The counts are dropped once event time has passed the day's end.
            self.handle.registerTimer((int(key[0]) + 1) * DAY_MS)
        batch = _in_order(rows, self.t)
        who = [None if pd.isna(v) else v for v in batch["visitor"].tolist()]
        keep = []
        for v in who:
            n = seen.get(v, 0)
            keep.append(n < self.cap)
            seen[v] = min(n + 1, self.cap)
        self.seen.update((list(seen), list(seen.values())))
        if any(keep):
            yield batch[self.columns][keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class SlidingLimiter(StatefulProcessor):
    """Accept a row when every window still has room; refused rows do not count and come out too.

    ``limits`` are (seconds, rows). State is the accepted times inside the widest
    window, never more than its limit. Keyed by address; the limit shared by
    everybody is the same processor under one key, which one task must hold.
    """

    def __init__(self, limits: list[tuple[float, int]], columns: list[str], t: str = "t", expire: bool = False):
        self.limits, self.columns, self.t, self.expire = limits, columns, t, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A key that is silent for the widest span has nothing left to remember.
        ttl = int(1000 * max(s for s, _ in self.limits)) if self.expire else None
        self.kept = handle.getListState("kept", T.StructType([T.StructField("t", T.DoubleType())]), ttlDurationMs=ttl)

    def handleInputRows(self, key, rows, timerValues):
        widest = max(s for s, _ in self.limits)
        kept = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        batch, flags = _in_order(rows, self.t), []
        for at in batch[self.t]:
            kept = [x for x in kept if x > at - widest]
            ok = all(sum(x > at - span for x in kept) < limit for span, limit in self.limits)
            if ok:
                kept.append(float(at))
            flags.append(ok)
        if kept:
            self.kept.put([(x,) for x in kept])
        yield batch[self.columns].assign(accepted=flags)

    def close(self) -> None:
        pass


class PlayMeter(StatefulProcessor):
    """Seconds of play into whole buckets; the rest comes out when the lesson changes or on idle."""

    def __init__(self, size: int = 30, idle_ms: int = 60_000):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("lesson", T.StringType()), T.StructField("s", T.DoubleType())]))

    def _rest(self, key, lesson, s):
        whole = int(s + 0.5)
        return [(key[0], lesson, min(whole, self.size))] if whole >= 1 else []

    def handleInputRows(self, key, rows, timerValues):
        lesson, s = self.open.get() if self.open.exists() else (None, 0.0)
        out = []
        batch = _in_order(rows, "t")
        for name, add in zip(batch["lesson"], batch["seconds"]):
            if lesson is not None and name != lesson:
                out += self._rest(key, lesson, s)
                s = 0.0
            lesson, s = name, s + max(0.0, float(add))
            while s >= self.size:
                out.append((key[0], lesson, self.size))
                s -= self.size
        self.open.update((lesson, s))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["visitor", "lesson", "seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            lesson, s = self.open.get()
            self.open.clear()
            rest = self._rest(key, lesson, s)
            if rest:
                yield pd.DataFrame(rest, columns=["visitor", "lesson", "seconds"])

    def close(self) -> None:
        pass


class StaleExport(StatefulProcessor):
    """Watch jobs in the export stage: ``check`` when stale, ``give_up`` at three times that; any newer status cancels."""

    def __init__(self, stage: str, stale_s: float = 720.0, give_up_s: float = 2160.0, recheck_s: float = 60.0):
        self.stage, self.stale, self.give_up, self.recheck = stage, int(stale_s * 1000), int(give_up_s * 1000), int(recheck_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", T.StructType([T.StructField("ms", T.LongType()), T.StructField("retry", T.LongType())]))

    def _cancel(self):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.since.clear()

    def handleInputRows(self, key, rows, timerValues):
        last = _in_order(rows, "updated_ms").iloc[-1]
        watched = last["state"] == "processing" and last["stage_message"] == self.stage
        if not watched:
            self._cancel()
        elif not self.since.exists() or self.since.get()[1] != int(last["retry_count"]):
            self._cancel()
            self.since.update((int(last["updated_ms"]), int(last["retry_count"])))
            self.handle.registerTimer(int(last["updated_ms"]) + self.stale)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.since.exists():
            return
        ms, retry = self.since.get()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        final = now >= ms + self.give_up
        if final:
            self.since.clear()
        else:
            self.handle.registerTimer(min(now + self.recheck, ms + self.give_up))
        yield pd.DataFrame([(key[0], retry, "give_up" if final else "check")], columns=["job_id", "retry_count", "verdict"])

    def close(self) -> None:
        pass


class LatestStatus(StatefulProcessor):
    """Newest status per job by (retry_count, updated_ms); rows of an older attempt or time are ignored."""

    def __init__(self, columns: list[str], keep_ms: int | None = None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", T.StructType([T.StructField("retry", T.LongType()), T.StructField("ms", T.LongType())]), ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["retry_count", "updated_ms"], kind="stable")
        last = batch.iloc[-1]
        new = (int(last["retry_count"]), int(last["updated_ms"]))
        if not self.at.exists() or tuple(self.at.get()) < new:
            self.at.update(new)
            yield batch.tail(1)[self.columns]

    def close(self) -> None:
        pass


class LatestStatuses(StatefulProcessor):
    """``LatestStatus`` of a part of the jobs, without expiry; their newest (retry_count, updated_ms) are one value, so that keys are few."""

    def __init__(self, columns: list[str], job: T.DataType):
        self.columns, self.job = columns, job

    def init(self, handle: StatefulProcessorHandle) -> None:
        longs = T.ArrayType(T.LongType())
        self.at = handle.getValueState("at", T.StructType([T.StructField("jobs", T.ArrayType(self.job)), T.StructField("retry", longs), T.StructField("ms", longs)]))

    def handleInputRows(self, key, rows, timerValues):
        known = {}
        if self.at.exists():
            jobs, retry, ms = self.at.get()
            known = dict(zip(jobs, zip(retry, ms)))
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["retry_count", "updated_ms"], kind="stable").drop_duplicates("job_id", keep="last")
        newer = []
        for job, *at in zip(batch["job_id"].tolist(), batch["retry_count"].tolist(), batch["updated_ms"].tolist()):
            job, at = None if pd.isna(job) else job, (int(at[0]), int(at[1]))
            newer.append(job not in known or known[job] < at)
            if newer[-1]:
                known[job] = at
        if any(newer):
            self.at.update((list(known), [a for a, _ in known.values()], [b for _, b in known.values()]))
            yield batch[self.columns][newer]

    def close(self) -> None:
        pass
