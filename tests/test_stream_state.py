"""Stateful streams against dictionaries, with restarts, expiry, lost ends and replayed batches."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadenza.operators import sinks
from cadenza.streaming import events as e
from cadenza.streaming import state as st

DAY = datetime(2024, 1, 1)


def at(days=0.0):
    return DAY + timedelta(days=days)


@pytest.fixture()
def fed(spark, tmp_path):
    """Runs an operator over batches of rows, each with a new start of the stream, and returns what it sent out."""

    def run(schema, batches, operator):
        own = f"file://{tmp_path}/{uuid.uuid4().hex}"
        with e.rocksdb(spark):
            for rows in batches:
                spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{own}/in")
                e.write_once(operator(spark.readStream.schema(schema).parquet(f"{own}/in")), f"{own}/out", f"{own}/state")
        return spark.read.parquet(f"{own}/out")

    return run


LIFE = "event_id long, phase string, at timestamp, playratio double, event_type string"


def test_ends_meet_their_starts_over_restarts(fed):
    batches = [
        [(1, "start", at(0), None, "playback_start"), (2, "start", at(0.1), None, "playback_start"), (3, "end", at(0.1), 0.5, "skip")],
        [(1, "end", at(0.2), 0.3, "skip"), (1, "start", at(0.2), None, "playback_start"), (3, "start", at(0.3), None, "playback_start")],
        [(1, "end", at(0.4), 0.9, "complete"), (3, "end", at(0.4), None, "complete"), (2, "end", at(1.1), 0.9, "complete")],
    ]
    got = st.latest_plays(fed(LIFE, batches, lambda x: st.merged_plays(x, keep=1))).orderBy("event_id", "updated_at").collect()
    assert [(r.kind, r.event_id, r.created_at, r.updated_at, r.playratio) for r in got] == [
        ("merged", 1, at(0), at(0.4), 0.9),
        ("lost", 2, None, at(1.1), 0.9),  # its start was forgotten after a day
        ("lost", 3, None, at(0.1), 0.5),
        ("merged", 3, at(0.3), at(0.4), 0.0),
    ]


def test_timer_forgets_starts(fed):
    """The watermark passes the end of the first start, so its state is gone before its own end comes."""
    batches = [[(1, "start", at(0), None, "x")], [(2, "start", at(5), None, "x")], [(1, "end", at(5.1), 1.0, "complete"), (2, "end", at(5.2), 1.0, "complete")]]
    got = fed(LIFE, batches, lambda x: st.merged_plays(x, keep=2)).collect()
    assert sorted((r.kind, r.event_id) for r in got) == [("lost", 1), ("merged", 2)]


def test_sessions_stick_until_login_or_expiry(fed):
    schema = "event_id long, user_id long, at timestamp, action string, own_session string"
    batches = [
        [(1, 7, at(0), "play", None), (2, 7, at(1), "play", "mine"), (3, 8, at(1), "play", None)],
        [(4, 7, at(13.9), "play", None), (5, 7, at(14), "play", None), (6, 8, at(2), "login", None)],
        [(7, 8, at(14.5), "play", None), (8, 7, at(15), "login", None), (9, 7, at(15), "play", None), (10, 7, at(28.5), "play", None)],
    ]
    got = {r.event_id: (r.session_id, r.session_start) for r in fed(schema, batches, st.sticky_sessions).collect()}
    starts = {k: v[1] for k, v in got.items()}
    assert starts == {1: at(0), 2: None, 3: at(1), 4: at(0), 5: at(14), 7: at(14.5), 9: at(15), 10: at(15)}
    assert got[2][0] == "mine" and got[1][0] == got[4][0] and len({got[k][0] for k in (1, 5, 9)}) == 3


def test_lists_move_to_front_have_caps_and_end(fed):
    schema = "session_id long, event_id long, at timestamp, action string, tracks array<long>"
    batches = [
        [(1, 1, at(0), "played", [10]), (1, 2, at(0.1), "played", [11]), (1, 3, at(0.2), "recommended", [1, 2, 3]), (2, 4, at(0), "recommended", [5])],
        [(1, 5, at(1), "played", [10]), (1, 6, at(1.1), "recommended", [4, 2]), (1, 7, at(1.2), "played", [12])],
        [(1, 8, at(2), "played", [13]), (3, 9, at(20), "played", [1])],
        [(2, 10, at(20.1), "recommended", [6])],
    ]
    operator = lambda x: st.track_lists(x, recent=3, recommended=4)
    read = lambda rows, now: {r.session_id: (r.recent, r.recommended) for r in st.latest_lists(rows, str(now)).collect()}
    before = fed(schema, batches[:2], operator)
    assert read(before, at(2)) == {1: ([12, 10, 11], [4, 2, 1, 3]), 2: ([], [5])}
    assert read(before, at(14.5)) == {1: ([12, 10, 11], [4, 2, 1, 3]), 2: ([], [])}
    rows = fed(schema, batches, operator)
    assert read(rows, at(21)) == {1: ([13, 12, 10], []), 2: ([], [6]), 3: ([1], [])}
    assert rows.where("session_id = 2 AND size(recommended) = 0").count() <= 1


def test_replayed_batch_leaves_revisions(spark, tmp_path):
    schema = "session_id long, event_id long, at timestamp, items array<long>"
    batches = [[(1, 1, at(0), [1]), (1, 2, at(1), [2]), (2, 3, at(0), [9])], [(1, 4, at(2), [3])], [(3, 5, at(3), [7])], [(2, 6, at(4), [8])]]
    table = st.QueueTable(spark, f"file://{tmp_path}/queues", compact=2)
    state = {}
    for batch, rows in enumerate(batches):
        for _ in range(3):
            table.write(spark.createDataFrame(rows, schema), batch)
        for session, _, _, items in rows:
            state[session] = (items, state.get(session, (None, 1))[1] + 1)
        assert {r.session_id: (r["items"], r.revision) for r in table.current().collect()} == state
    table.write(spark.createDataFrame(batches[-1], schema), 3)
    assert {r.session_id: (r["items"], r.revision) for r in table.current().collect()} == state
    assert {r.session_id for r in spark.read.parquet(f"file://{tmp_path}/queues/part-2").collect()} == {1, 2, 3}


def test_chained_exports_without_gap_or_overlap(spark, tmp_path):
    schema = "event_id long, session_int_id long, user_int_id long, track_id long, playratio double, created_at timestamp_ntz, updated_at timestamp_ntz"
    plays = spark.createDataFrame([(i, 3_000_000 + i % 3, i % 3, i, 0.5, at(i), at(i)) for i in range(9)], schema)
    root = f"file://{tmp_path}/exports"
    sinks.export_next(plays, root, "a", str(at(2)))
    broken = {"session_tracks": plays.limit(1).select(F.col("session_int_id").alias("session_id"))}
    broken["session_tracks"].write.parquet(f"{root}/b/session_tracks.parquet")  # a run that ended before its checkpoint
    assert sinks.last_checkpoint(spark, root)[0].startswith("2024-01-03")
    sinks.export_next(plays, root, "b", str(at(5)))
    sinks.export_next(plays, root, "b", str(at(7)))  # the same version again is not exported again
    sinks.export_next(plays, root, "c", str(at(8)))
    found = sinks.exported(spark, root).groupBy("version").agg(F.sort_array(F.collect_list("track_id")).alias("t")).orderBy("version").collect()
    assert [(r.version, r.t) for r in found] == [("a", [0, 1, 2]), ("b", [3, 4, 5]), ("c", [6, 7, 8])]
    ends = sinks.checkpoints(spark, root, sinks.WHOLE_CHECKPOINT).orderBy("version").collect()
    assert [(r.session_tracks_rows, r.rows_exported["session_meta"], r.session_int_id_watermark) for r in ends] == [(3, 3, 3_000_002)] * 3
