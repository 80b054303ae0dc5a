import datetime

import pytest

from cadenza.operators import monitoring as m
from cadenza.operators import sinks
from cadenza.sources import files


def test_manifest_names_defaults_and_stems(spark, tmp_path):
    (tmp_path / "m.csv").write_text("tid,File,song,artist_name,length_sec\n1,,One,A,3.5\n,/x/b.c.mp3, ,,\n,,Lost,A,1\n 7 ,.hidden,,B,long\n")
    got = [tuple(r)[:5] for r in files.manifest(spark, str(tmp_path / "m.csv")).orderBy("track_id").collect()]
    assert got == [("1", "One", "A", "", 3.5), ("7", "7", "B", "", 0.0), ("b.c", "b.c", "Unknown Artist", "", 0.0)]


def test_required_columns_and_rows(spark, tmp_path):
    (tmp_path / "full.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert files.csv_required(spark, str(tmp_path / "full.csv"), ["b"]).count() == 1
    with pytest.raises(ValueError, match="c, d"):
        files.csv_required(spark, str(tmp_path / "full.csv"), ["d", "a", "c"])
    with pytest.raises(ValueError, match="no rows"):
        files.csv_required(spark, str(tmp_path / "empty.csv"), ["a"])


def test_json_documents_and_listing(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "catalog.json").write_text('{\n "tracks": [{"id": 1, "title": "x"},\n {"id": 2}]\n}')
    (tmp_path / "song.MP3").write_text("x")
    (tmp_path / "empty.mp3").write_text("")
    rows = files.json_rows(spark, str(tmp_path / "deep"), "tracks array<struct<id:bigint,title:string>>", "tracks").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, None)]
    assert sorted(r.stem for r in files.listing(spark, str(tmp_path), (".mp3",)).collect()) == ["empty", "song"]
    assert files.listing(spark, str(tmp_path)).count() == 3


def test_newest_prefix_by_time_then_name(spark):
    day = datetime.datetime(2024, 1, 2)
    rows = [("s/v1/manifest.json", day), ("s/v2/manifest.json", day), ("s/v3/manifest.json", day - datetime.timedelta(1)), ("s/v9/other.json", day)]
    found = files.newest_prefix(spark.createDataFrame(rows, "path string, modified timestamp_ntz"))
    assert found.first().prefix == "s/v2/"


def test_export_is_written_once(spark, tmp_path):
    root = str(tmp_path / "export")
    rows = spark.createDataFrame([(5, 1), (9, 2)], "session_id long, track_id long")
    sinks.export_version({"session_tracks": rows}, root, "v1")
    sinks.export_version({"session_tracks": rows.limit(0)}, root, "v1")
    sinks.export_version({"session_tracks": rows.limit(0)}, root, "v2", last=9)
    assert sorted(map(tuple, sinks.checkpoints(spark, root).collect())) == [("v1", "success", 2, 9), ("v2", "success", 0, 9)]
    assert spark.read.parquet(f"{root}/v1/session_tracks.parquet").count() == 2


def test_joint_rollup_of_a_window(spark):
    at = datetime.datetime(2024, 1, 1, 12)
    requests = spark.createDataFrame(
        [(1, "m1", "healthy", False, "", "none", 10.0, 2, "A", [1, 1], at), (2, "m2", "", None, "E1", None, 30.0, 4, "A", [1, 2], at), (3, "m2", "degraded", False, None, "pop", None, None, None, None, at)],
        """metric_id long, model_version string, fallback_state string, pipeline_error boolean, error_code string, fallback_level string,
        total_latency_ms double, returned_count int, artist string, track_ids array<int>, created_at timestamp_ntz""",
    )
    plays = spark.createDataFrame(
        [("skip", 0.1, at), ("complete", None, at), ("playback_start", 0.9, at), ("playback_start", None, at), ("stream_failure_x", None, at), (None, None, at)],
        "event_type string, playratio double, created_at timestamp_ntz",
    )
    feedback = spark.createDataFrame([("dislike", at), ("like", at), (None, at)], "feedback_type string, created_at timestamp_ntz")
    args = ("1d", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    got = m.joint_rollup(requests, plays, feedback, *args).first().asDict()
    assert (got["request_count"], got["repeat_violation_count"], got["error_rate"], got["fallback_rate"]) == (3, 1, 0.333333, 0.333333)
    assert (got["p50_latency_ms"], got["p95_latency_ms"], got["avg_returned_count"], got["model_version"]) == (10.0, 30.0, 2.0, "m2")
    assert (got["finalized_playback_count"], got["completion_rate"], got["skip_rate"], got["stream_failure_count"]) == (3, 0.666667, 0.333333, 1)
    assert (got["dislike_rate"], got["stream_failure_rate"], got["top_artist_share"], got["sample_status"]) == (0.333333, 0.166667, 1.0, "insufficient")
    empty = m.joint_rollup(requests.limit(0), plays.limit(0), feedback.limit(0), *args).first()
    assert (empty.request_count, empty.skip_rate, empty.p95_latency_ms, empty.sample_status, empty.model_version) == (0, 0.0, 0.0, "insufficient", None)
