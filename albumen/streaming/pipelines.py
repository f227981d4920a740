"""Streaming forms of throughput, work queues, late results, leases and limits.

Keyed state has event-time timers: what can no longer bear on a decision leaves the state store once the watermark
has passed it. Actions that arrive later than the watermark (`late` behind the newest seen) are not decided.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from albumen.operators.membership import FORGET_SECONDS, FREE_TRIES, INVITE_GAP, INVITES_PER_HOUR, LOCK_SECONDS, MOST_LOCK
from albumen.operators.status import CLIENT_STAGES, LEASE_SECONDS

#: Seconds after an upload in which results of its steps are waited for.
LATE_RESULT_SECONDS = 750


def throughput(events: DataFrame, minutes: int = 10, late: str = "750 seconds") -> DataFrame:
    """Count and bytes per metric and window (an extension); events later than the watermark are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "metric")
    sums = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return sums.select(F.col("window.start").alias("start"), "metric", "n", "bytes", (F.col("bytes") / (minutes * 60)).alias("bytes_per_s"))


def work_queue(messages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each batch to `handle`. A batch is taken once its files are committed; a handler's own errors are its
    own to record, as a message is never given twice on their account."""
    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_results(uploads: DataFrame, results: DataFrame, wait: int = LATE_RESULT_SECONDS, late: str = "60 seconds", steps: tuple[str, ...] = CLIENT_STAGES) -> DataFrame:
    """(key, step, uploaded, status) of two streams, uploads (key, uploaded) and results (key, step, status, reported).

    A step is known as soon as a result reports it within `wait` seconds of the upload, one row per result. A step
    that none reports has no data, told once the watermarks of both streams have passed the wait; what has been told
    leaves the state. Results from before the upload, after the wait, or of no upload, are ignored.
    """
    asked = uploads.withWatermark("uploaded", late).select("key", "uploaded", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    told = results.withWatermark("reported", late).select(F.col("key").alias("r_key"), F.trim("step").alias("r_step"), "status", "reported")
    in_time = (F.col("reported") >= F.col("uploaded")) & (F.col("reported") <= F.col("uploaded") + F.expr(f"INTERVAL {wait} SECONDS"))
    rows = asked.join(told, (F.col("key") == F.col("r_key")) & (F.col("step") == F.col("r_step")) & in_time, "left_outer")
    return rows.select("key", "step", "uploaded", F.coalesce("status", F.lit("no_data")).alias("status"))


def _by_key(actions: DataFrame, decide: Callable, out: str, state: str, late: str) -> DataFrame:
    """`decide` over the actions of each key, under a watermark of their times (`at`, seconds since 1970). What is at
    the watermark itself counts as late, and the first watermark is 0: times are a millisecond on, so 0 is let in."""
    timed = actions.withColumn("__ts", F.timestamp_micros((F.col("at") * 1e6).cast("long") + 1000)).withWatermark("__ts", late)
    return timed.groupBy("key").applyInPandasWithState(decide, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _keep_until(state: GroupState, value: tuple, until: float) -> None:
    """State that a timer removes once no action that the watermark lets in can be before `until`."""
    state.update(value)
    state.setTimeoutTimestamp(max(math.ceil(until * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def _in_order(frames, by: list[str]) -> pd.DataFrame:
    """All of a batch's actions on the key, which Arrow may deliver in parts, in the order of their times."""
    return pd.concat(list(frames)).sort_values(["at", *by])


def _lease(key, frames, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    owner, until = state.get if state.exists else (None, 0.0)
    out = []
    for r in _in_order(frames, ["owner", "action"]).itertuples(index=False):
        free = owner is None or r.at >= until
        if r.action == "claim":
            ok = free or owner == r.owner
        else:
            ok = owner == r.owner and r.at < until
        if ok and r.action in ("claim", "heartbeat"):
            owner, until = r.owner, r.at + LEASE_SECONDS
        elif ok:
            owner, until = None, 0.0
        out.append((key[0], r.owner, r.action, bool(ok)))
    if owner is not None:
        _keep_until(state, (owner, until), until)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["key", "owner", "event", "accepted"])


def leases(actions: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Claims, heartbeats and releases (key, owner, action, at in seconds) decided in order per key; a lease lasts
    120 seconds from its claim or last heartbeat. A lease that ran out is noticed by the next action on its key, and
    leaves the state by a timer if there is none."""
    return _by_key(actions, _lease, "key string, owner string, event string, accepted boolean", "owner string, until double", late)


def _limit(gap: int, per_window: int, window: int):
    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, start, n = state.get if state.exists else (None, None, 0)
        out = []
        for r in _in_order(frames, ["event_id"]).itertuples(index=False):
            ok = last is None or r.at - last >= gap
            if ok and (start is None or r.at - start >= window):
                start, n = r.at, 0
            ok = ok and n < per_window
            if ok:
                last, n = r.at, n + 1
            out.append((key[0], r.event_id, bool(ok)))
        if start is not None:
            _keep_until(state, (last, start, n), max(start + window, (start if last is None else last) + gap))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    return run


def rate_limits(events: DataFrame, gap: int = INVITE_GAP, per_window: int = INVITES_PER_HOUR, window: int = 3600, late: str = "60 seconds") -> DataFrame:
    """(key, event_id, allowed) of a stream (key, event_id, at in seconds): the rule of membership.rate_limited, with
    the last that passed and the open window kept as state until both are over. Events of a batch are taken by their
    time."""
    return _by_key(events, _limit(gap, per_window, window), "key string, event_id long, allowed boolean", "last double, start double, n long", late)


def _lock(key, frames, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    last, n = state.get if state.exists else (None, 0)
    out = []
    for r in _in_order(frames, ["event_id"]).itertuples(index=False):
        n = 1 if last is None or r.at - last > FORGET_SECONDS else n + 1
        last = r.at
        over = n - FREE_TRIES
        out.append((key[0], r.event_id, min(LOCK_SECONDS * 2 ** min(over - 1, 30), MOST_LOCK) if over > 0 else 0))
    _keep_until(state, (last, n), last + FORGET_SECONDS)
    yield pd.DataFrame(out, columns=["key", "event_id", "lock_seconds"])


def lockouts(failures: DataFrame, late: str = "60 seconds") -> DataFrame:
    """(key, event_id, lock_seconds) of a stream of failures (key, event_id, at in seconds): the rule of
    membership.locked_out, with the last failure and their number kept as state until they are forgotten."""
    return _by_key(failures, _lock, "key string, event_id long, lock_seconds int", "last double, n long", late)


def lease_state(actions: DataFrame, now: float) -> DataFrame:
    """The batch form: who holds each key at `now` by its last claim or heartbeat that no release follows."""
    last = actions.groupBy("key").agg(F.max_by(F.struct("owner", "action", "at"), "at").alias("x")).select("key", "x.*")
    return last.where((F.col("action") != "release") & (F.col("at") + LEASE_SECONDS > now)).select("key", "owner")
