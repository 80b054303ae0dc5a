"""The processors of plays and lists are called once for a bucket of keys, not once for each key."""

import numpy as np
import pandas as pd

from cadenza.streaming import state as st


class Held:
    """State and timers of one bucket, as Spark's handle gives them; `calls` counts what is asked of it."""

    def __init__(self):
        self.calls, self.rows, self.map, self.timers = 0, [], {}, set()

    def getListState(self, *_):
        return self

    def getMapState(self, *_):
        held = Held()
        return held

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def exists(self):
        return bool(self.rows or self.map)

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)


class Info:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_many_plays_are_few_calls():
    n, held, merge = 5000, Held(), st.EventMerge(keep=2)
    merge.init(held)
    starts = pd.DataFrame({"event_id": np.arange(n), "phase": "start", "us": np.arange(n) + 5, "playratio": 0.0, "event_type": "x"})
    ends = starts.assign(phase="end", us=starts["us"] + st.DAY_US, playratio=0.5)
    assert [len(x) for x in merge.handleInputRows((0,), iter([starts[:3000], starts[3000:]]), None)] == [0]
    (out,) = merge.handleInputRows((0,), iter([ends, ends.assign(event_id=ends["event_id"] + n)]), None)
    assert held.calls < 20
    found = out.set_index("event_id").sort_index()
    assert (found["kind"].loc[: n - 1] == "merged").all() and (found["kind"].loc[n:] == "lost").all()
    assert found["created_at"].loc[: n - 1].tolist() == starts["us"].tolist() and found["created_at"].loc[n:].isna().all()
    assert held.timers == {3 * st.DAY_US // 1000}
    list(merge.handleExpiredTimer((0,), None, Info(3 * st.DAY_US // 1000)))
    assert held.rows == []


def test_lists_of_a_bucket_stay_apart_and_end():
    lists = st.TrackLists(recent=2, recommended=3, days=1)
    lists.init(Held())
    row = lambda session, event, us, action, tracks: {"session_id": session, "event_id": event, "us": us, "action": action, "tracks": tracks}
    batch = [row(1, 1, 1, "played", ["7"]), row(2, 2, 2, "played", [None]), row(1, 3, 3, "played", ["8"]), row(1, 4, 4, "played", ["7"]), row(2, 5, 5, "recommended", ["1", "2", "1"])]
    out = lambda rows: {r.session_id: (r.version, r.recent, r.recommended, None if pd.isna(r.until) else r.until) for x in rows for r in x.itertuples()}
    assert out(lists.handleInputRows((0,), iter([pd.DataFrame(batch)]), None)) == {1: (1, ["7", "8"], [], None), 2: (1, [None], ["1", "2"], 5 + st.DAY_US)}
    more = pd.DataFrame([row(2, 6, 6, "recommended", ["3", "2", "4"]), row(2, 7, 7, "played", ["9"])])
    assert out(lists.handleInputRows((0,), iter([more]), None)) == {2: (2, ["9", None], ["3", "2", "4"], 6 + st.DAY_US)}
    day = 2 * st.DAY_US // 1000
    assert lists.handle.timers == {day}
    assert out(lists.handleExpiredTimer((0,), None, Info(day))) == {2: (3, ["9", None], [], None)}
    assert out(lists.handleExpiredTimer((0,), None, Info(day))) == {}
