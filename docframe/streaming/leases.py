"""Leases as keyed state: a stream of what workers do with work items, each claim under a token of its own.

The state of an item is a value (status, attempt, owner, token, end of the lease), the list of its attempts, and a timer at
the lease's end. What a worker does counts only under the token, attempt and name that its claim was given, and before the
lease's end. When the watermark passes that end, the attempt expires and the item waits again, or fails if it has no
attempts left. ``replayed`` gives the same rows for a table of actions.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_ATTEMPTS = 3
ACTIONS = "work_item_id long, at timestamp, action string, worker string, token string, attempt int, seconds int"
#: One row for each action and each lease that ran out, with at in place of at_us; ended_* say which attempt that ended, and how.
OUT = "work_item_id long, at_us long, action string, note string, status string, attempt_count int, lease_owner string, lease_token string, ended_attempt int, ended_status string"
_STATE = "status string, attempt int, owner string, token string, until_us long"
_ATTEMPT = "attempt int, token string, worker string, status string, started_us long, finished_us long"


def lease_token(item: int, attempt: int, worker: str, at_us: int) -> str:
    """What ``keyed_id`` gives for the same parts, so that batches and streams issue the same tokens."""
    digest = hashlib.sha256(f"{item}:{attempt}:{worker}:{at_us}".encode()).digest()[:12]
    return "lease_" + base64.urlsafe_b64encode(digest).decode()


@dataclass(frozen=True)
class Item:
    status: str = "pending"
    attempt: int = 0
    owner: str = ""
    token: str = ""
    until_us: int = 0


@dataclass(frozen=True)
class Step:
    """What one action did: the state after it, a note, and the attempt that it ended, if any."""

    item: Item
    note: str
    ended: tuple[int, str] | None = None
    started: bool = False


def lapse(item: Item) -> Step:
    """A lease that ran out."""
    over = item.attempt >= MAX_ATTEMPTS
    freed = replace(item, status="failed" if over else "pending", owner="", token="", until_us=0)
    return Step(freed, "work_item_attempts_exhausted" if over else "execution_lease_expired", (item.attempt, "expired"))


def act(key: int, item: Item, at_us: int, action: str, worker: str, token: str | None, attempt: int | None, seconds: int | None) -> Step:
    """One action on an item whose lease, if any, has not run out."""
    if action == "claim":
        if item.status != "pending" or not seconds or seconds < 1:
            return Step(item, "ignored")
        number = item.attempt + 1
        taken = Item("leased", number, worker, lease_token(key, number, worker, at_us), at_us + seconds * 1_000_000)
        return Step(taken, "claimed", started=True)
    holds = item.status == "leased" and (item.owner, item.token, item.attempt) == (worker, token, attempt)
    if not holds:
        return Step(item, "ignored")
    if action == "renew" and seconds and seconds > 0:
        return Step(replace(item, until_us=at_us + seconds * 1_000_000), "renewed")
    freed = replace(item, owner="", token="", until_us=0)
    if action == "complete":
        return Step(replace(freed, status="completed"), "completed", (item.attempt, "completed"))
    if action == "fail":
        over = item.attempt >= MAX_ATTEMPTS
        return Step(replace(freed, status="failed" if over else "pending"), "failed" if over else "retry", (item.attempt, "failed"))
    return Step(item, "ignored")


def steps(key: int, item: Item, actions: Iterable[tuple], until_us: int | None = None) -> Iterator[tuple[int, str, Step]]:
    """(time, action, step) of (at_us, action, worker, token, attempt, seconds) in order of time, with the leases that ran out in between.

    With ``until_us``, those that ran out by then after the last action too.
    """
    for at, action, worker, token, attempt, seconds in sorted(actions, key=lambda a: (a[0], a[1], a[2] or "")):
        if item.status == "leased" and item.until_us <= at:
            step = lapse(item)
            yield item.until_us, "expire", step
            item = step.item
        step = act(key, item, at, action, worker, token, attempt, seconds)
        yield at, action, step
        item = step.item
    if until_us is not None and item.status == "leased" and item.until_us <= until_us:
        yield item.until_us, "expire", lapse(item)


def _row(key: int, at: int, action: str, step: Step) -> tuple:
    ended = step.ended or (None, None)
    return (key, at, action, step.note, step.item.status, step.item.attempt, step.item.owner, step.item.token, *ended)


_NAMES = [c.split()[0] for c in OUT.split(", ")]


class Leases(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _STATE)
        self.attempts = handle.getListState("attempts", _ATTEMPT)

    def _load(self) -> Item:
        return Item(*self.item.get()) if self.item.exists() else Item()

    def _keep(self, before: Item, after: Item, made: list[tuple[int, Step]]) -> None:
        if after.until_us != before.until_us:
            if before.until_us:
                self.handle.deleteTimer(_timer(before.until_us))
            if after.until_us:
                self.handle.registerTimer(_timer(after.until_us))
        self.item.update((after.status, after.attempt, after.owner, after.token, after.until_us))
        rows = {a[0]: tuple(a) for a in self.attempts.get()} if self.attempts.exists() else {}
        for at, step in made:
            if step.started:
                rows[step.item.attempt] = (step.item.attempt, step.item.token, step.item.owner, "active", at, None)
            if step.ended:
                number, status = step.ended
                rows[number] = (*rows[number][:3], status, rows[number][4], at)
        if rows:
            self.attempts.put([rows[n] for n in sorted(rows)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = item = self._load()
        actions = [(r["at_us"], r["action"], r["worker"], r["token"], r["attempt"], r["seconds"]) for r in rows]
        made = []
        for at, action, step in steps(key[0], item, actions):
            made.append((at, step))
            item = step.item
            yield Row(**dict(zip(_NAMES, _row(key[0], at, action, step), strict=True)))
        self._keep(before, item, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        item = self._load()
        # A timer of a lease that was renewed or ended meanwhile says nothing.
        if item.status == "leased" and _timer(item.until_us) <= expiredTimerInfo.getExpiryTimeInMs():
            step = lapse(item)
            self.item.update((step.item.status, step.item.attempt, "", "", 0))
            rows = [tuple(a) for a in self.attempts.get()]
            number, status = step.ended
            self.attempts.put([(*a[:3], status, a[4], item.until_us) if a[0] == number else a for a in rows])
            yield Row(**dict(zip(_NAMES, _row(key[0], item.until_us, "expire", step), strict=True)))

    def close(self) -> None:
        pass


def _timer(until_us: int) -> int:
    """The first millisecond at which a lease has run out."""
    return -(-until_us // 1000)


def _timed(actions: DataFrame) -> DataFrame:
    # Python sees times in its machine's zone; microseconds are the same everywhere.
    return actions.withColumn("at_us", F.unix_micros("at"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at_us", F.timestamp_micros("at_us")).withColumnRenamed("at_us", "at")


def lease_states(actions: DataFrame, late: str = "0 seconds") -> DataFrame:
    """OUT's rows of a stream of ACTIONS, which come in order of time from batch to batch. Needs the RocksDB state store."""
    return _shown(_timed(actions).withWatermark("at", late).groupBy("work_item_id").transformWithState(Leases(), OUT, "Append", "EventTime"))


def replayed(actions: DataFrame, until: dt.datetime | None = None) -> DataFrame:
    """The same rows for a table of ACTIONS; leases that ran out by ``until`` (UTC) are taken to have expired."""
    end = (until.replace(tzinfo=until.tzinfo or dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1) if until else None

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        none = lambda x: None if pd.isna(x) else x
        rows = [(int(at), action, worker, none(token), none(attempt), int(seconds) if none(seconds) is not None else None) for at, action, worker, token, attempt, seconds in zip(frame["at_us"], frame["action"], frame["worker"], frame["token"], frame["attempt"], frame["seconds"], strict=True)]
        out = [_row(int(key[0]), at, action, step) for at, action, step in steps(int(key[0]), Item(), rows, end)]
        return pd.DataFrame(out, columns=_NAMES).astype({"ended_attempt": "Int32"})

    return _shown(_timed(actions).groupBy("work_item_id").applyInPandas(run, OUT))


def attempts(states: DataFrame) -> DataFrame:
    """(work_item_id, attempt_number, lease_token, worker_id, status, started_at, finished_at): a row for each claim in ``states``."""
    started = states.filter("note = 'claimed'").select("work_item_id", F.col("attempt_count").alias("attempt_number"), "lease_token", F.col("lease_owner").alias("worker_id"), F.col("at").alias("started_at"))
    ended = states.filter("ended_attempt is not null").select("work_item_id", F.col("ended_attempt").alias("attempt_number"), F.col("ended_status").alias("_ended"), F.col("at").alias("finished_at"))
    return started.join(ended, ["work_item_id", "attempt_number"], "left").withColumn("status", F.coalesce("_ended", F.lit("active"))).select("work_item_id", "attempt_number", "lease_token", "worker_id", "status", "started_at", "finished_at")
