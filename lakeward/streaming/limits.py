"""Rate limits over event time: for each client, then for all of them together.

Requests wait in state until the watermark has passed them, so they are judged in the
order of their times however they arrive. Clients are dealt into lots, and a lot's state is
the waiting requests of its clients and the times they passed within the window, at most as
many for each as its limit, packed; an event-time timer takes them out once they have left
the window, so state is bounded by the clients of one window and one delay, not by all
there ever were.

A request that its client's limit refuses does not count for the total; one that the
total refuses has counted for its client.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A request as whole numbers: flags are 1 without a client and 2 without an event_id.
ROW = ["at", "event_id", "client", "flags", "verdict"]
AT, EVENT, CLIENT, FLAGS, VERDICT = range(len(ROW))
SCHEMA = "at long, event_id long, client long, flags long, verdict long, ts timestamp"
VERDICTS = ("passed", "client", "total")
#: Lots that clients are dealt into, and requests refused by them on their way past the total.
LOTS = 512
#: Slices of the total's window, and requests that a task holds before they go into state.
SLICES, HELD = 48, 500_000


@contextmanager
def kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which state of this kind needs, for the queries started within."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class Window(StatefulProcessor):
    """Lets each client of a lot, or without ``each`` all of the lot together, pass at most
    ``most`` times in ``micros``; the requests it refuses have ``verdict``, a place in VERDICTS.

    Requests that wait are packed, some thousands in one value of the state, by slices of
    time; a watermark opens the slices it has reached, one after the other.
    """

    def __init__(self, most: int, micros: int, verdict: int, each: bool) -> None:
        self.most, self.micros, self.verdict, self.each = most, micros, verdict, each
        self.slice = max(1, micros if each else micros // SLICES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "n long")
        self.passed = handle.getValueState("passed", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0
        for frame in rows:
            part = frame[ROW].to_numpy(np.int64)
            past = part[:, VERDICT] != 0  # refused before: it goes past this limit
            if past.any():
                yield _told(part[past])
                part = part[~past]
            if len(part):
                first = min(x for x in (first, int(part[:, AT].min())) if x is not None)
                held, n = [*held, part], n + len(part)
            if n > HELD:
                self._wait(np.concatenate(held))
                held, n = [], 0
        if n:
            self._wait(np.concatenate(held))
        if first is not None:
            self.handle.registerTimer(_due(first))

    def _wait(self, rows: np.ndarray) -> None:
        n = self.parts.get()[0] if self.parts.exists() else 0
        slices = rows[:, AT] // self.slice
        order = np.argsort(slices, kind="stable")
        starts = np.flatnonzero(np.diff(slices[order], prepend=slices[order[0]] - 1))
        for part in np.split(order, starts[1:]):
            self.waiting.updateValue((int(slices[part[0]]), n), (rows[part].tobytes(),))
            n += 1
        self.parts.update((n,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        recent = _rows(self.passed.get()[0], 3) if self.passed.exists() else np.zeros((0, 3), np.int64)
        chunks: dict[int, list[int]] = {}
        for place, part in self.waiting.keys() if self.parts.exists() else ():
            chunks.setdefault(place, []).append(part)
        due = [place for place in sorted(chunks) if _due(place * self.slice) <= mark]
        later, rest = min((p for p in chunks if p not in set(due)), default=None), None
        for place in due:
            rows = np.concatenate([_rows(self.waiting.getValue((place, part))[0], len(ROW)) for part in chunks[place]])
            for part in chunks[place]:
                self.waiting.removeKey((place, part))
            ready = -(-rows[:, AT] // 1000) <= mark
            if not ready.all():  # in the last of them only
                rest = rows[~ready]
            recent = self._judge(judged := rows[ready], recent)
            for at in range(0, len(judged), HELD):
                yield _told(judged[at : at + HELD])
        recent = recent[-(-(recent[:, 2] + self.micros) // 1000) > mark]
        if rest is not None:
            self._wait(rest)
        elif later is None:
            self.parts.clear()
        if len(recent):
            self.passed.update((np.ascontiguousarray(recent).tobytes(),))
        else:
            self.passed.clear()
        if rest is not None:
            self.handle.registerTimer(_due(int(rest[:, AT].min())))
        elif later is not None:
            self.handle.registerTimer(_due(later * self.slice))
        elif len(recent):
            self.handle.registerTimer(_due(int(recent[:, 2].max()) + self.micros))

    def _judge(self, rows: np.ndarray, recent: np.ndarray) -> np.ndarray:
        """Puts the verdict into ``rows``, in the order of time; the client, its flag and time of
        each request that passed and may still count, those of ``recent`` among them."""
        flag, client = (rows[:, FLAGS] & 1, rows[:, CLIENT]) if self.each else (np.zeros(len(rows), np.int64),) * 2
        order = np.lexsort((rows[:, EVENT], rows[:, FLAGS] & 2 ^ 2, rows[:, AT], client, flag))
        rows[:], flag, client = rows[order], flag[order], client[order]
        new = np.flatnonzero(np.diff(client, prepend=client[:1]) | np.diff(flag, prepend=flag[:1]))
        before: dict[tuple[int, int], list[int]] = {}
        for f, c, at in recent.tolist():
            before.setdefault((f, c), []).append(at)
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
            if a < b:
                name = (int(flag[a]), int(client[a]))
                passed, before[name] = passing(rows[a:b, AT], self.most, self.micros, before.get(name, []))
                rows[a:b, VERDICT] = np.where(passed, 0, self.verdict)
        return np.array([(f, c, at) for (f, c), times in before.items() for at in times], np.int64).reshape(-1, 3)

    def close(self) -> None:
        pass


def passing(times: np.ndarray, most: int, micros: int, before: list[int]) -> tuple[np.ndarray, list[int]]:
    """Which of ``times``, in order, pass if at most ``most`` do in ``micros``, and the last
    times that passed; ``before`` are those that passed earlier. Where ``most`` have passed,
    the next to do so is looked up, so the steps are those that pass and not those that come."""
    passed, i = np.zeros(len(times), bool), 0
    recent = deque(before, maxlen=most) if most else deque()
    while most and i < len(times):
        if len(recent) == most and recent[0] + micros > times[i]:
            i += int(np.searchsorted(times[i:], recent[0] + micros))
        else:
            passed[i] = True
            recent.append(int(times[i]))
            i += 1
    return passed, list(recent)


def _rows(packed: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(-1, columns)


def _told(rows: np.ndarray) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=ROW)
    return frame.assign(ts=pd.to_datetime(frame["at"], unit="us", utc=True))


def _due(at: int) -> int:
    """The watermark, in milliseconds, from which on a time has passed."""
    return -(-at // 1000)


def limited(stream: DataFrame, client: str, event_id: str, time: str, per_client: int, total: int, seconds: int) -> DataFrame:
    """client, event_id, ts, at and verdict (``passed``, or the limit that refused it:
    ``client`` or ``total``) of each request, once the watermark has passed it.

    ``stream`` has a watermark on ``time``. Requests of one time are judged by event_id;
    a null client is one of its own. The total is one key, whose task sees the requests
    that passed their clients, a slice of time after the other, and holds ``total`` times;
    those refused go past it. A request without a time is never passed by a watermark.
    """
    flags = F.when(F.col(client).isNull(), 1).otherwise(0) + F.when(F.col(event_id).isNull(), 2).otherwise(0)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias
    rows = stream.where(F.col(time).isNotNull()).select(
        F.unix_micros(time).alias("at"), number(event_id)("event_id"), number(client)("client"), flags.cast("long").alias("flags"), F.lit(0).cast("long").alias("verdict"), F.col(time).alias("ts")
    )
    micros, lots = seconds * 1_000_000, F.lit(LOTS)
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64("client", F.col("flags").bitwiseAND(1)), lots))
    each = dealt.groupBy("lot").transformWithStateInPandas(Window(per_client, micros, 1, True), SCHEMA, "Append", "EventTime", eventTimeColumnName="ts")
    past = each.withColumn("lot", F.when(F.col("verdict") == 0, 0).otherwise(1 + F.pmod(F.xxhash64("event_id"), lots)))
    out = past.groupBy("lot").transformWithStateInPandas(Window(total, micros, 2, False), SCHEMA, "Append", "EventTime", eventTimeColumnName="ts")
    known = lambda c, flag: F.when(F.col("flags").bitwiseAND(flag) == 0, F.col(c)).alias(c)
    return out.select(known("client", 1), known("event_id", 2), "ts", "at", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("verdict").cast("int") + 1).alias("verdict"))
