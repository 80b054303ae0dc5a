"""Keyed state of event streams: plays from start to end, sticky sessions, track lists with a time to live, queue revisions.

The processors keep their state in Spark's state store, so a stream that is stopped between two batches goes on from its
checkpoint. Times are those of the events: what has a time to live is dropped by event-time timers once the watermark has
passed its end, and is not looked at beyond it even where the timer has not run yet. All events of a key in one batch are
taken in the order of their times.

Plays and lists have very many keys with a few events each. They are dealt into `BUCKETS` buckets by a hash of the key, and a
processor is called once for the bucket, not once for each key: its state holds all keys of the bucket, and the timers of
a bucket run at the end of the day.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PLAY = "kind string, event_id bigint, created_at bigint, updated_at bigint, playratio double, event_type string"
SESSION = "event_id bigint, user_id bigint, at bigint, session_id string, session_start bigint"
LISTS = "session_id bigint, version bigint, recent array<string>, recommended array<string>, until bigint"
#: Times inside the processors are microseconds (column `us`), those of timers milliseconds.
DAY_US = 86_400_000_000
#: The checkpoint of a stream depends on this number.
BUCKETS = 1024
#: Stands for a key that is null while rows are in a processor, where whole numbers have no nulls.
NO_KEY = -(1 << 63)


def _timer(us: int) -> int:
    """The first millisecond that is not before `us`."""
    return -(-us // 1000)


def _in_order(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("us", F.unix_micros("at")).withWatermark("at", delay)


def _times(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({name: F.timestamp_micros(name) for name in names})


def _last_day(us: int) -> int:
    """The number of the first day that begins at `us` or later."""
    return -(-us // DAY_US)


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return rows.withColumn(key, F.coalesce(key, F.lit(NO_KEY)))


def _unbucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(key, F.nullif(F.col(key), F.lit(NO_KEY)))


class EventMerge(StatefulProcessor):
    """Ends (skip or complete) are merged into the start of the same id; an end that finds no start goes out as lost.

    The first start of an id counts. Every end gives a merged row, so the latest of an id holds. A start is forgotten `keep`
    days after it began; a later end is lost. A batch adds its new starts to those of the bucket as one row of (id, us) pairs.
    """

    def __init__(self, keep: int = 1):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", "pairs binary")

    def _pairs(self) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(row[0]) for row in self.starts.get()), dtype=np.int64).reshape(-1, 2)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows.iloc[np.lexsort((rows["phase"] != "start", rows["us"]))]
        begun, new, created = dict(self._pairs().tolist()), [], []
        for own, us, start in zip(rows["event_id"].tolist(), rows["us"].tolist(), (rows["phase"] == "start").tolist(), strict=True):
            known = begun.get(own)
            if known is not None and us >= known + self.keep * DAY_US:
                known = None
            if not start:
                created.append(known)
            elif known is None:
                begun[own] = us
                new.append((own, us))
        if new:
            self.starts.appendValue((np.array(new, dtype=np.int64).tobytes(),))
            for day in {_last_day(us + self.keep * DAY_US) for _, us in new}:
                self.handle.registerTimer(_timer(day * DAY_US))
        ends = rows[rows["phase"] != "start"]
        created = pd.array(created, dtype="Int64")
        kind = np.where(created.isna(), "lost", "merged").astype(object)
        yield pd.DataFrame(
            {"kind": kind, "event_id": ends["event_id"].array, "created_at": created, "updated_at": ends["us"].array, "playratio": ends["playratio"].array, "event_type": ends["event_type"].array}
        )

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        pairs = self._pairs()
        left = pairs[pairs[:, 1] + self.keep * DAY_US > expiredTimerInfo.getExpiryTimeInMs() * 1000]
        if len(left):
            self.starts.put([(left.tobytes(),)])
        else:
            self.starts.clear()
        return iter(())

    def close(self) -> None:
        pass


class StickySession(StatefulProcessor):
    """A user's plays belong to one session until `days` after it began, or until the user logs in anew.

    A play with an id of its own keeps that and leaves the sticky session alone. A session's id is made of the user and the
    microsecond of its first play.
    """

    def __init__(self, days: int = 14):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        begun = self.begun.get()[0] if self.begun.exists() else None
        before = begun
        for row in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
            if row["action"] == "login":
                begun = None
            elif row["own_session"] is not None:
                yield Row(event_id=row["event_id"], user_id=key[0], at=row["us"], session_id=row["own_session"], session_start=None)
            else:
                if begun is None or row["us"] >= begun + self.days * DAY_US:
                    begun = row["us"]
                yield Row(event_id=row["event_id"], user_id=key[0], at=row["us"], session_id=f"{key[0]}-{begun}", session_start=begun)
        if begun is None:
            self.begun.clear()
        elif begun != before:
            self.begun.update((begun,))
            self.handle.registerTimer(_timer(begun + self.days * DAY_US))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.begun.exists() and _timer(self.begun.get()[0] + self.days * DAY_US) <= expiredTimerInfo.getExpiryTimeInMs():
            self.begun.clear()
        return iter(())

    def close(self) -> None:
        pass


class TrackLists(StatefulProcessor):
    """The played and the recommended tracks of a session, newest first, each once, at most `recent` and `recommended`.

    A played track moves to the front. Recommended tracks come before those of earlier calls, in their order; the list lives
    `days` from its last change, which is sent out as `until`. Every batch that changes a session sends out both lists with a
    growing version. A bucket knows which sessions' lists may end on a day. Tracks are texts in here, as a track can be null.
    """

    def __init__(self, recent: int = 50, recommended: int = 500, days: int = 14):
        self.most, self.days = {"played": recent, "recommended": recommended}, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = handle.getMapState("lists", "session_id bigint", "played array<string>, recommended array<string>, us bigint, version bigint")
        self.ends = handle.getMapState("ends", "day bigint", "sessions array<bigint>")

    def _row(self, session: int, version: int, recent: list, recommended: list, last: int | None) -> tuple:
        return session, version, recent, recommended, None if last is None else last + self.days * DAY_US

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows.iloc[np.lexsort((rows["event_id"], rows["us"]))]
        anything, found = self.lists.exists(), {}
        for session, us, kind, tracks in zip(*(rows[c].tolist() for c in ("session_id", "us", "action", "tracks")), strict=True):
            if session not in found:
                played, recommended, last, version = (self.lists.getValue((session,)) if anything else None) or ([], [], None, 0)
                # the newest track is the last one here
                found[session] = {"played": OrderedDict.fromkeys(reversed(played)), "recommended": OrderedDict.fromkeys(reversed(recommended)), "last": last, "version": version, "again": False}
            own = found[session]
            if own["last"] is not None and us >= own["last"] + self.days * DAY_US:
                own["recommended"], own["last"] = OrderedDict(), None
            for track in reversed(tracks):
                own[kind][track] = None
                own[kind].move_to_end(track)
            while len(own[kind]) > self.most[kind]:
                own[kind].popitem(last=False)
            if kind == "recommended":
                own["last"], own["again"] = us, True
        out, ends = [], {}
        for session, own in found.items():
            played, recommended = list(reversed(own["played"])), list(reversed(own["recommended"]))
            self.lists.updateValue((session,), (played, recommended, own["last"], own["version"] + 1))
            if own["again"]:
                ends.setdefault(_last_day(own["last"] + self.days * DAY_US), []).append(session)
            out.append(self._row(session, own["version"] + 1, played, recommended, own["last"]))
        for day, sessions in ends.items():
            before = self.ends.getValue((day,))
            self.ends.updateValue((day,), (list({*(before[0] if before else ()), *sessions}),))
            self.handle.registerTimer(_timer(day * DAY_US))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        day, out = now // DAY_US, []
        sessions = self.ends.getValue((day,))
        for session in sessions[0] if sessions else ():
            played, _, last, version = self.lists.getValue((session,))
            if last is not None and last + self.days * DAY_US <= now:
                self.lists.updateValue((session,), (played, [], None, version + 1))
                out.append(self._row(session, version + 1, list(played), [], None))
        self.ends.removeKey((day,))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    session, version, recent, recommended, until = zip(*rows, strict=True)
    return pd.DataFrame({"session_id": session, "version": version, "recent": recent, "recommended": recommended, "until": pd.array(until, dtype="Int64")})


def merged_plays(events: DataFrame, keep: int = 1, delay: str = "1 hour") -> DataFrame:
    """(kind, event_id, created_at, updated_at, playratio, event_type) from (event_id, phase, at, playratio, event_type)."""
    rows = _bucketed(_in_order(events, delay), "event_id").withColumn("playratio", F.coalesce("playratio", F.lit(0.0)))
    merged = rows.groupBy("bucket").transformWithStateInPandas(EventMerge(keep), PLAY, "Append", "EventTime")
    return _times(_unbucketed(merged, "event_id"), "created_at", "updated_at")


def sticky_sessions(events: DataFrame, days: int = 14, delay: str = "1 hour") -> DataFrame:
    """(event_id, user_id, at, session_id, session_start) of plays, from (event_id, user_id, at, action, own_session)."""
    found = _in_order(events, delay).groupBy("user_id").transformWithState(StickySession(days), SESSION, "Append", "EventTime")
    return _times(found, "at", "session_start")


def track_lists(actions: DataFrame, recent: int = 50, recommended: int = 500, days: int = 14, delay: str = "1 hour") -> DataFrame:
    """(session_id, version, recent, recommended, until) from (session_id, event_id, at, action, tracks)."""
    rows = _bucketed(_in_order(actions, delay), "session_id").withColumn("tracks", F.col("tracks").cast("array<string>"))
    lists = rows.groupBy("bucket").transformWithStateInPandas(TrackLists(recent, recommended, days), LISTS, "Append", "EventTime")
    tracks = {name: F.col(name).cast("array<bigint>") for name in ("recent", "recommended")}
    return _times(_unbucketed(lists, "session_id").withColumns(tracks), "until")


def latest_plays(rows: DataFrame) -> DataFrame:
    """One merged row of each id, that of its last end, and all lost ends."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("updated_at"), "event_type"))
    merged = rows.where("kind = 'merged'").withColumn("_place", place).where("_place = 1").drop("_place")
    return merged.unionByName(rows.where("kind = 'lost'"))


def latest_lists(rows: DataFrame, now: str) -> DataFrame:
    """The lists of each session after its last change, as read at `now`: a list whose time is up is empty, its timer run or not."""
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("recent", "recommended", "until"), "version").alias("l"))
    alive = F.col("l.until") > F.lit(now).cast("timestamp")
    return last.select("session_id", "l.recent", F.when(alive, F.col("l.recommended")).otherwise(F.array().cast("array<bigint>")).alias("recommended"))


class QueueTable:
    """Queues in a folder: one part for each batch, with the queues that it changed and their revisions.

    A batch that comes again overwrites its own part, computed from those before it, so replaying it changes nothing. The
    revision of a queue is 1 before any write and goes up by one with each. Every `compact`-th part holds all queues, and
    readers begin at the last of these.
    """

    SCHEMA = "session_id bigint, items array<bigint>, revision bigint, at timestamp, batch bigint"

    def __init__(self, spark: SparkSession, root: str, compact: int = 16):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact

    def before(self, batch: int) -> DataFrame:
        """All queues as they were before a batch."""
        first = max(0, (batch - 1) // self.compact * self.compact)
        paths = [f"{self.root}/part-{k}" for k in range(first, batch) if self._exists(k)]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("batch")))
        return rows.withColumn("_place", place).where("_place = 1").drop("_place")

    def _exists(self, batch: int) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/part-{batch}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, writes: DataFrame, batch: int) -> None:
        """For foreachBatch: `writes` (session_id, event_id, at, items) of one batch."""
        new = writes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "event_id", "items")).alias("w"))
        old = self.before(batch).select("session_id", F.col("items").alias("old_items"), F.col("revision").alias("old_revision"), F.col("at").alias("old_at"), F.col("batch").alias("old_batch"))
        both = new.join(old, "session_id", "full" if batch % self.compact == 0 else "left")
        rows = both.select(
            "session_id",
            F.coalesce("w.items", "old_items").alias("items"),
            (F.coalesce("old_revision", F.lit(1)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("revision"),
            F.coalesce("w.at", "old_at").alias("at"),
            F.when(F.col("n").isNotNull(), F.lit(batch)).otherwise(F.col("old_batch")).cast("bigint").alias("batch"),
        )
        rows.write.mode("overwrite").parquet(f"{self.root}/part-{batch}")

    def current(self) -> DataFrame:
        """All queues after the last batch there is."""
        batch = 0
        while self._exists(batch):
            batch += 1
        return self.before(batch)


def arrive(rows: DataFrame, at: str, cuts: list[str], folder: str, run) -> None:
    """`rows` come in as files, those up to each cut of `at` and then the rest, and `run` is called after each: as many restarts."""
    when, low = F.col(at), None
    for cut in [*cuts, None]:
        part = rows if low is None else rows.where(when > F.lit(low).cast("timestamp"))
        part = part if cut is None else part.where(when <= F.lit(cut).cast("timestamp"))
        part.write.mode("append").parquet(folder)
        run()
        low = cut
