"""Queries over exports, table changes, monitoring, decisions and streams. QUERIES: name to (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import export as x
from cadenza.operators import monitoring as m
from cadenza.operators import tables as t
from cadenza.plans.oracle_views import sql
from cadenza.sources import views as v
from cadenza.streaming import events as e

LAST, CUTOFF = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
DAY, NEXT_DAY = "2024-01-15 00:00:00", "2024-01-16 00:00:00"


def _delta(s: SparkSession, d: str) -> DataFrame:
    return x.delta(v.plays(s, d), LAST, CUTOFF)


def session_positions(s: SparkSession, d: str) -> DataFrame:
    return x.positioned(v.plays(s, d)).select("event_id", "session_int_id", "position")


def delta_by_update(s: SparkSession, d: str) -> DataFrame:
    return x.delta(v.plays(s, d), LAST, CUTOFF, "updated_at")


def delta_dq_violations(s: SparkSession, d: str) -> DataFrame:
    return x.violations(v.session_tracks(s, d), v.playlist_tracks(s, d))


def delta_row_counts(s: SparkSession, d: str) -> DataFrame:
    rows = _delta(s, d)
    return x.row_counts({"session_tracks": rows, "session_meta": x.session_meta(rows), "love": v.loved_tracks(s, d), "users": v.users(s, d)})


def active_users(s: SparkSession, d: str) -> DataFrame:
    online = v.users(s, d).where("user_int_id >= 100000").select("user_int_id")
    seen = v.plays(s, d).select((F.col("user_int_id") + 100_000).alias("user_int_id"))
    return online.join(seen, "user_int_id", "left_semi")


def playlist_delta(s: SparkSession, d: str) -> DataFrame:
    owners = v.table(s, d, "orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_custkey").alias("user_id"), "o_orderdate")
    owners = owners.where((F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") <= F.lit("1997-03-01").cast("timestamp_ntz")))
    return v.playlist_tracks(s, d).join(owners, "playlist_id").select("playlist_id", "user_id", "place", "track_id")


def _batch(s: SparkSession, d: str) -> DataFrame:
    key = F.col("track_id")
    nav = F.when(key % 7 == 0, F.concat(F.lit("nav_"), key + 7)).when(key % 7 == 1, F.concat(F.lit("nav_"), key + 1)).otherwise(F.concat(F.lit("new_"), key))
    return v.catalog(s, d).where("track_id % 7 IN (0, 1, 3)").select("track_id", nav.alias("nav_id"))


def mapping_merge(s: SparkSession, d: str) -> DataFrame:
    return t.merge_mappings(v.catalog(s, d), _batch(s, d))


def _small_catalog(s: SparkSession, d: str) -> DataFrame:
    return v.catalog(s, d).select("track_id", "title", "nav_id")


def _changes(s: SparkSession, d: str) -> DataFrame:
    some = _small_catalog(s, d).where("track_id % 10 = 0")
    return some.select((F.col("track_id") * 3).alias("track_id"), F.upper("title").alias("title"), F.when(F.col("track_id") % 20 == 0, F.lit("moved")).alias("nav_id"))


def catalog_upsert(s: SparkSession, d: str) -> DataFrame:
    return t.upsert(_small_catalog(s, d), _changes(s, d), ["track_id"], ("nav_id",))


def insert_ignore(s: SparkSession, d: str) -> DataFrame:
    return t.insert_ignore(_small_catalog(s, d), _changes(s, d), ["track_id"])


def keyed_update(s: SparkSession, d: str) -> DataFrame:
    return t.update_existing(_small_catalog(s, d), _changes(s, d), ["track_id"])


def upsert_new_ids(s: SparkSession, d: str) -> DataFrame:
    lists = v.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("owner"), (F.col("n_nationkey") + 1).cast("bigint").alias("id"))
    rows = lists.where("id % 5 = 0").select("name", (F.col("owner") + 10).alias("owner")).unionByName(lists.where("id % 4 = 0").select(F.concat(F.lit("new "), "name").alias("name"), "owner"))
    return t.upsert_with_ids(lists, rows, ["name"], "id")


def replace_group(s: SparkSession, d: str) -> DataFrame:
    rows = v.playlist_tracks(s, d).select("playlist_id", "place", "track_id")
    new = rows.where("playlist_id % 4 = 0 AND place <= 2").withColumn("track_id", F.col("track_id") + 1)
    return t.replace_groups(rows, new, ["playlist_id"])


def delete_joined(s: SparkSession, d: str) -> DataFrame:
    bad = v.catalog(s, d).where("quarantine_reason IS NOT NULL").select("track_id")
    return t.delete_matching(v.playlist_tracks(s, d).select("playlist_id", "place", "track_id"), bad, ["track_id"])


def quality_report(s: SparkSession, d: str) -> DataFrame:
    rows = v.catalog(s, d)
    return t.quality_report(rows.unionByName(rows.where("track_id % 50 = 0").withColumn("title", F.lit(" "))))


def artist_relations(s: SparkSession, d: str) -> DataFrame:
    files = v.catalog(s, d).select(F.col("track_id").alias("media_id"), F.concat("title", F.lit(".mp3")).alias("filename"), F.concat_ws("-", "artist", "duration_sec").alias("title"))
    tracks = v.catalog(s, d).select(F.concat("title", F.lit(".mp3")).alias("path"), F.concat_ws("-", "artist", "duration_sec").alias("track_key"), "artist")
    return t.artist_relations(files, tracks)


def artist_stats(s: SparkSession, d: str) -> DataFrame:
    return t.artist_stats(v.catalog(s, d))


def request_rollup(s: SparkSession, d: str) -> DataFrame:
    return m.request_rollup(v.request_metrics(s, d), ["model_version"])


def playback_rollup(s: SparkSession, d: str) -> DataFrame:
    return m.playback_rollup(m.in_window(v.plays(s, d), DAY, NEXT_DAY), ["user_int_id"])


def model_version_mode(s: SparkSession, d: str) -> DataFrame:
    return m.first_mode(v.request_metrics(s, d), "model_version", ["created_at", "metric_id"], ["returned_count"])


def repeated_lists(s: SparkSession, d: str) -> DataFrame:
    lists = v.playlist_tracks(s, d).groupBy("playlist_id").agg(F.array_join(F.collect_list((F.col("track_id") % 50).cast("string")), ",").alias("tracks"))
    return m.repeated_lists(lists, "tracks")


def _states(s: SparkSession, d: str) -> DataFrame:
    key = F.col("metric_id")
    return v.request_metrics(s, d).select(
        "metric_id",
        (key % 7).alias("playable_count"),
        (key % 3).alias("ranked_count"),
        "returned_count",
        (key % 11 != 0).alias("bundle_available"),
        "pipeline_error",
        (key % 6 == 0).alias("degraded"),
        F.when(key % 4 == 0, "fallback_only").otherwise("normal").alias("action"),
        F.when(key % 9 == 0, "reported").alias("status_reason"),
    )


def serving_state(s: SparkSession, d: str) -> DataFrame:
    return m.serving_state(_states(s, d)).select("metric_id", "state", "fallback_level", "reason")


def session_status(s: SparkSession, d: str) -> DataFrame:
    queues = _states(s, d).withColumn("fallback_level", F.when(F.col("ranked_count") == 0, "non_personalized").otherwise("none"))
    return m.session_status(queues).select("metric_id", "fallback_state", "degraded_reason")


def rollback_decision(s: SparkSession, d: str) -> DataFrame:
    daily = v.request_metrics(s, d).withColumn("day", F.date_format("created_at", "yyyy-MM"))
    rolled = m.request_rollup(daily, ["model_version", "day"])
    rolled = rolled.withColumn("previous_version", F.when(F.col("model_version") != "m0", "m0"))
    return m.rollback_decision(rolled, {"max_fallback_rate": 0.42, "max_error_rate": 0.08}).select("model_version", "day", "decision", "reason")


def promotion_decision(s: SparkSession, d: str) -> DataFrame:
    rolled = m.request_rollup(v.request_metrics(s, d), ["returned_count"])
    rows = rolled.select("returned_count", F.col("fallback_rate").alias("recall"), F.col("error_rate").alias("mrr"), F.lit(0.42).alias("baseline_recall"), F.lit(0.09).alias("baseline_mrr"))
    return m.promotion_decision(rows, min_recall=0.38, max_recall_drop=0.01, max_mrr_drop=0.02).select("returned_count", "decision", "reason")


def activation_gate(s: SparkSession, d: str) -> DataFrame:
    key = F.col("metric_id")
    rows = v.request_metrics(s, d).select("metric_id", "model_version", F.when(key % 3 == 0, "Approved").when(key % 3 == 1, "approve").otherwise("block").alias("decision"), F.when(key % 4 == 0, F.lit("m1")).alias("decided_version"))
    return m.activation_gate(rows, F.col("metric_id") % 5 == 0).select("metric_id", "activated", "gate")


def model_version_transitions(s: SparkSession, d: str) -> DataFrame:
    """The first request of each version and day stands for an activation: versions times days, not requests."""
    at = F.col("created_at") + F.make_dt_interval(secs=F.col("metric_id") % 50)
    return t.activations(v.request_metrics(s, d).groupBy("model_version", "created_at").agg(F.min(at).alias("activated_at")))


def hourly_rates(s: SparkSession, d: str) -> DataFrame:
    final = v.plays(s, d).where("playratio IS NOT NULL")
    n = F.count(F.lit(1))
    return m.hourly(final, F.round(F.count(F.when(F.col("event_type") == "skip", 1)) / n, 4).alias("skip_rate"), F.round(F.count(F.when(F.col("event_type") == "complete", 1)) / n, 4).alias("completion_rate"))


def hourly_volume(s: SparkSession, d: str) -> DataFrame:
    plays = v.plays(s, d)
    streams = {"playback": plays, "skips": plays.where("event_type = 'skip'"), "late": plays.where("date_trunc('hour', updated_at) > date_trunc('hour', created_at)")}
    parts = [m.hourly(rows, F.count(F.lit(1)).alias("n")).withColumn("stream", F.lit(name)) for name, rows in streams.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hourly_uniques(s: SparkSession, d: str) -> DataFrame:
    return m.hourly(v.plays(s, d), F.count_distinct("user_int_id").alias("n_users"), F.count_distinct("track_id").alias("n_tracks"), F.count_distinct("session_int_id").alias("n_sessions"))


def skip_completion_ratio(s: SparkSession, d: str) -> DataFrame:
    final = v.plays(s, d).where("playratio IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("playratio") < 0.2, 1)).alias("s"), F.count(F.when(F.col("playratio") >= 0.8, 1)).alias("c"))
    none = F.nullif(F.col("n"), F.lit(0))
    return final.select(F.round(F.col("s") / none, 4).alias("skip_ratio"), F.round(F.col("c") / none, 4).alias("completion_ratio"))


def rejections(s: SparkSession, d: str) -> DataFrame:
    """Open plays stand for rejected events: by type, with the last day's number."""
    bad = v.plays(s, d).where("playratio IS NULL")
    kind = F.concat(F.lit("type"), F.col("track_id") % 3)
    return bad.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("created_at") > F.lit("2024-01-29 23:59:00").cast("timestamp_ntz"), 1)).alias("n_last_day"))


def rejection_rate(s: SparkSession, d: str) -> DataFrame:
    number = lambda condition: v.plays(s, d).where(condition).agg(F.count(F.lit(1)).alias("n"))
    counts = number("playratio IS NULL").select(F.col("n").alias("rejected")).crossJoin(number("playratio IS NOT NULL").select(F.col("n").alias("accepted")))  # one row each
    return counts.select(F.round(F.col("rejected") / F.nullif(F.col("rejected") + F.col("accepted"), F.lit(0)), 4).alias("rejection_rate"))


def like_rate(s: SparkSession, d: str) -> DataFrame:
    likes = v.plays(s, d).where("event_type = 'complete'").agg(F.count(F.lit(1)).alias("likes"))
    shown = v.plays(s, d).agg(F.count_distinct("session_int_id", "track_id").alias("shown"))
    return likes.crossJoin(shown).select(F.round(F.col("likes") / F.nullif(F.col("shown"), F.lit(0)), 4).alias("like_rate"))


def sessions_after_watermark(s: SparkSession, d: str) -> DataFrame:
    mark = x.watermark(_delta(s, d), 0)
    return v.plays(s, d).crossJoin(F.broadcast(mark)).agg(F.count_distinct("session_int_id").alias("n_sessions"), F.count_distinct(F.when(F.col("session_int_id") > F.col("session_int_id_watermark"), F.col("session_int_id"))).alias("n_beyond"))


def latest_rollup(s: SparkSession, d: str) -> DataFrame:
    return m.latest(v.request_metrics(s, d).select("metric_id", "created_at", "total_latency_ms"), "created_at", 1, "metric_id")


def recent_decisions(s: SparkSession, d: str) -> DataFrame:
    return m.latest(v.request_metrics(s, d).where("pipeline_error").select("metric_id", "created_at", "fallback_state"), "created_at", 5, "metric_id")


def fallback_state_counts(s: SparkSession, d: str) -> DataFrame:
    return v.request_metrics(s, d).groupBy("fallback_state").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(s: SparkSession, d: str) -> DataFrame:
    rows = v.request_metrics(s, d).withColumn("endpoint", F.when(F.col("metric_id") % 2 == 0, "bootstrap").otherwise("next"))
    return m.latency_summary(rows)


def trailing_rollups(s: SparkSession, d: str) -> DataFrame:
    rows = m.trailing_windows(v.plays(s, d), DAY, {"5m": "5 MINUTES", "1h": "1 HOUR", "1d": "1 DAY"})
    return m.playback_rollup(rows, ["window_name"])


QUERIES = {
    "session_positions": (session_positions, sql("plays", "SELECT event_id, session_int_id, (row_number() OVER (PARTITION BY session_int_id ORDER BY created_at, event_id) - 1)::INTEGER AS position FROM plays WHERE playratio IS NOT NULL")),
    "delta_export_window": (_delta, sql("delta", "SELECT * REPLACE (position::INTEGER AS position) FROM delta")),
    "delta_export_by_update": (delta_by_update, sql("plays", """SELECT session_int_id AS session_id, user_int_id AS user_id, position::INTEGER AS position, track_id, playratio, CASE WHEN playratio > 0.8 THEN 'positive' WHEN playratio > 0.2 THEN 'neutral' ELSE 'skip' END AS label
      FROM (SELECT *, row_number() OVER (PARTITION BY session_int_id ORDER BY created_at, event_id) - 1 AS position FROM plays WHERE playratio IS NOT NULL) WHERE updated_at > TIMESTAMP '2024-01-10' AND updated_at <= TIMESTAMP '2024-01-20'""")),
    "delta_session_meta": (lambda s, d: x.session_meta(_delta(s, d)), sql("delta", "SELECT DISTINCT session_id, user_id FROM delta")),
    "delta_dq_violations": (delta_dq_violations, sql("st pt", """SELECT 'unknown_label' AS "check", count(*) FILTER (label NOT IN ('positive', 'neutral', 'skip')) AS n FROM st UNION ALL SELECT 'ratio_out_of_range', count(*) FILTER (playratio NOT BETWEEN 0 AND 1) FROM st
      UNION ALL SELECT 'session_position', count(*) - count(DISTINCT (session_id, position)) FROM st UNION ALL SELECT 'playlist_position', count(*) - count(DISTINCT (playlist_id, position)) FROM pt""")),
    "delta_row_counts": (delta_row_counts, sql("delta loved us", """SELECT 'session_tracks' AS output, count(*) AS n_rows FROM delta UNION ALL SELECT 'session_meta', count(*) FROM (SELECT DISTINCT session_id, user_id FROM delta)
      UNION ALL SELECT 'love', count(*) FROM loved UNION ALL SELECT 'users', count(*) FROM us""")),
    "delta_watermark": (lambda s, d: x.watermark(_delta(s, d), 3_000_000), sql("delta", "SELECT coalesce(max(session_id), 3000000) AS session_int_id_watermark FROM delta")),
    "retrain_trigger": (lambda s, d: x.retrain_trigger(_delta(s, d)), sql("delta", "SELECT count(*) AS n_rows, count(*) >= 1000 AS triggered FROM delta")),
    "degradation_flag": (lambda s, d: x.degradation(v.plays(s, d), DAY, NEXT_DAY), sql("plays", """SELECT n AS n_events, k AS n_skips, CASE WHEN n = 0 THEN 0 ELSE round(k / n, 6) END AS skip_rate, CASE WHEN n < 50 THEN 'unchanged' WHEN n > 0 AND round(k / n, 6) > 0.8 THEN 'set' ELSE 'clear' END AS action
      FROM (SELECT count(*) AS n, count(*) FILTER (playratio < 0.2) AS k FROM plays WHERE playratio IS NOT NULL AND created_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16')""")),
    "active_users": (active_users, sql("us plays", "SELECT user_int_id FROM us WHERE user_int_id >= 100000 AND user_int_id IN (SELECT user_int_id + 100000 FROM plays)")),
    "playlist_delta": (playlist_delta, sql("pt", "SELECT playlist_id, o_custkey AS user_id, place::INTEGER AS place, track_id FROM pt JOIN orders ON o_orderkey = playlist_id WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-03-01'")),
    "mapping_merge": (mapping_merge, sql("batch", """SELECT b.track_id, c.nav_id AS old_nav_id, b.nav_id FROM batch b JOIN cat c USING (track_id) WHERE b.nav_id IS DISTINCT FROM c.nav_id AND NOT EXISTS (
      SELECT 1 FROM cat o WHERE o.nav_id = b.nav_id AND o.track_id <> b.track_id AND o.track_id NOT IN (SELECT b2.track_id FROM batch b2 JOIN cat c2 USING (track_id) WHERE b2.nav_id IS DISTINCT FROM c2.nav_id))""")),
    "catalog_upsert": (catalog_upsert, sql("cat", """SELECT coalesce(n.track_id, c.track_id) AS track_id, coalesce(n.title, c.title) AS title, coalesce(n.nav_id, c.nav_id) AS nav_id FROM cat c
      FULL JOIN (SELECT track_id * 3 AS track_id, upper(title) AS title, CASE WHEN track_id % 20 = 0 THEN 'moved' END AS nav_id FROM cat WHERE track_id % 10 = 0) n ON n.track_id = c.track_id""")),
    "insert_ignore": (insert_ignore, sql("cat", """SELECT track_id, title, nav_id FROM cat UNION ALL SELECT * FROM (SELECT track_id * 3 AS track_id, upper(title) AS title, CASE WHEN track_id % 20 = 0 THEN 'moved' END AS nav_id FROM cat WHERE track_id % 10 = 0)
      WHERE track_id NOT IN (SELECT track_id FROM cat)""")),
    "keyed_update": (keyed_update, sql("cat", """SELECT c.track_id, coalesce(n.title, c.title) AS title, coalesce(n.nav_id, c.nav_id) AS nav_id FROM cat c
      LEFT JOIN (SELECT track_id * 3 AS track_id, upper(title) AS title, CASE WHEN track_id % 20 = 0 THEN 'moved' END AS nav_id FROM cat WHERE track_id % 10 = 0) n ON n.track_id = c.track_id""")),
    "upsert_new_ids": (upsert_new_ids, """SELECT n_name AS name, CASE WHEN (n_nationkey + 1) % 5 = 0 THEN n_regionkey + 10 ELSE n_regionkey END::BIGINT AS owner, (n_nationkey + 1)::BIGINT AS id FROM nation
      UNION ALL SELECT 'new ' || n_name, n_regionkey::BIGINT, (SELECT max(n_nationkey) + 1 FROM nation) + row_number() OVER (ORDER BY 'new ' || n_name) FROM nation WHERE (n_nationkey + 1) % 4 = 0"""),
    "replace_group": (replace_group, sql("pt", """SELECT playlist_id, place::INTEGER AS place, track_id FROM pt WHERE playlist_id % 4 <> 0 UNION ALL SELECT playlist_id, place::INTEGER, track_id + 1 FROM pt WHERE playlist_id % 4 = 0 AND place <= 2""")),
    "delete_joined": (delete_joined, sql("pt cat", "SELECT playlist_id, place::INTEGER AS place, track_id FROM pt WHERE track_id NOT IN (SELECT track_id FROM cat WHERE quarantine_reason IS NOT NULL)")),
    "quality_report": (quality_report, sql("cat", """SELECT n_rows, n_repeated, n_missing, n_unmapped, n_quarantined, round(n_repeated / n_rows, 6) AS repeated_rate, round(n_missing / n_rows, 6) AS missing_rate, round(n_unmapped / n_rows, 6) AS unmapped_rate,
      round(n_quarantined / n_rows, 6) AS quarantined_rate, concat_ws(',', CASE WHEN n_repeated / n_rows > 0.05 THEN 'repeated_high' END, CASE WHEN n_missing / n_rows > 0.05 THEN 'missing_high' END, CASE WHEN n_unmapped / n_rows > 0.05 THEN 'unmapped_high' END,
      CASE WHEN n_quarantined / n_rows > 0.05 THEN 'quarantined_high' END) AS notes, CASE WHEN greatest(n_repeated, n_missing, n_unmapped, n_quarantined) / n_rows > 0.05 THEN 'warning' ELSE 'ok' END AS status
      FROM (SELECT count(*) AS n_rows, count(*) - count(DISTINCT track_id) AS n_repeated, count(*) FILTER (trim(title) = '') AS n_missing, count(*) FILTER (nav_id IS NULL) AS n_unmapped, count(*) FILTER (availability_status = 'quarantined') AS n_quarantined
      FROM (SELECT track_id, title, nav_id, availability_status FROM cat UNION ALL SELECT track_id, ' ', nav_id, availability_status FROM cat WHERE track_id % 50 = 0))""")),
    "artist_relations": (artist_relations, sql("cat", """SELECT DISTINCT f.track_id AS media_id, t.artist, r.role FROM cat f JOIN cat t ON f.title = t.title OR (f.artist = t.artist AND f.duration_sec = t.duration_sec), (VALUES ('artist'), ('albumartist')) r(role)""")),
    "artist_stats": (artist_stats, sql("cat", """SELECT artist, n_tracks, n_albums, total_sec, first_track, '{"albumCount":' || n_albums || ',"songCount":' || n_tracks || ',"size":' || total_sec || '}' AS as_json
      FROM (SELECT artist, count(DISTINCT track_id) AS n_tracks, count(DISTINCT album) AS n_albums, sum(duration_sec)::BIGINT AS total_sec, min(track_id) AS first_track FROM cat GROUP BY 1)""")),
    "request_rollup": (request_rollup, sql("roll", "SELECT * FROM roll")),
    "playback_rollup": (playback_rollup, sql("plays", """SELECT user_int_id, n AS n_events, f AS finalized_count, CASE WHEN f = 0 THEN 0 ELSE round(c / f, 6) END AS completion_rate, CASE WHEN f = 0 THEN 0 ELSE round(s / f, 6) END AS skip_rate, 0.0::DOUBLE AS stream_failure_rate FROM (
      SELECT user_int_id, count(*) AS n, count(*) FILTER (fin) AS f, count(*) FILTER (fin AND event_type = 'skip') AS s, count(*) FILTER (fin AND (event_type = 'complete' OR coalesce(playratio, 0) >= 0.8)) AS c
      FROM (SELECT *, event_type IN ('skip', 'complete') OR playratio IS NOT NULL AS fin FROM plays WHERE created_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16') GROUP BY 1)""")),
    "model_version_mode": (model_version_mode, sql("rm", """SELECT returned_count, model_version, round(c / t, 6) AS share FROM (SELECT *, sum(c) OVER (PARTITION BY returned_count) AS t, row_number() OVER (PARTITION BY returned_count ORDER BY c DESC, f) AS r
      FROM (SELECT returned_count, model_version, count(*) AS c, min((created_at, metric_id)) AS f FROM rm GROUP BY 1, 2)) WHERE r = 1""")),
    "repeated_lists": (repeated_lists, sql("pt", "SELECT count(*) AS repeat_violation_count FROM (SELECT playlist_id FROM pt GROUP BY 1 HAVING count(*) <> count(DISTINCT track_id % 50))")),
    "serving_state": (serving_state, sql("rm", """SELECT metric_id, CASE WHEN p < 4 OR returned_count < least(4, p) THEN 'catalog_insufficient' WHEN metric_id % 11 = 0 OR pipeline_error THEN 'model_unavailable' WHEN metric_id % 6 = 0 AND metric_id % 4 = 0 THEN 'fallback_only' WHEN metric_id % 6 = 0 THEN 'model_degraded'
      WHEN returned_count = 0 OR metric_id % 3 = 0 THEN 'fallback_only' ELSE 'healthy' END AS state, CASE WHEN p < 4 OR returned_count < least(4, p) THEN 'catalog_safe_fallback' WHEN metric_id % 11 = 0 THEN 'non_personalized' WHEN pipeline_error THEN 'catalog_safe_fallback'
      WHEN metric_id % 6 = 0 AND metric_id % 4 = 0 THEN 'catalog_safe_fallback' WHEN metric_id % 6 = 0 THEN 'non_personalized' WHEN returned_count = 0 OR metric_id % 3 = 0 THEN 'catalog_safe_fallback' ELSE 'none' END AS fallback_level,
      CASE WHEN p < 4 OR returned_count < least(4, p) THEN 'catalog_insufficient' WHEN metric_id % 11 = 0 THEN 'model_unavailable' WHEN pipeline_error THEN 'pipeline_error' WHEN metric_id % 6 = 0 THEN CASE WHEN metric_id % 9 = 0 THEN 'reported' ELSE 'manual_degraded' END
      WHEN returned_count = 0 OR metric_id % 3 = 0 THEN 'empty_ranked_output' END AS reason FROM (SELECT *, metric_id % 7 AS p FROM rm)""")),
    "session_status": (session_status, sql("rm", """SELECT metric_id, CASE WHEN metric_id % 6 = 0 THEN CASE WHEN metric_id % 4 = 0 THEN 'fallback_only' ELSE 'model_degraded' END WHEN metric_id % 3 = 0 THEN 'fallback_only' ELSE 'healthy' END AS fallback_state,
      CASE WHEN metric_id % 6 = 0 THEN CASE WHEN metric_id % 9 = 0 THEN 'reported' ELSE 'manual_degraded' END WHEN metric_id % 3 = 0 THEN 'session_fallback_queue' END AS degraded_reason FROM rm""")),
    "rollback_decision": (rollback_decision, sql("rm", """SELECT model_version, day, CASE WHEN r = 'insufficient_sample' OR r = 'within_thresholds' THEN 'no_action' WHEN r IN ('high_error_rate', 'high_fallback_rate') AND model_version <> 'm0' THEN 'recommend_rollback' ELSE 'mark_degraded' END AS decision,
      r || CASE WHEN r IN ('high_error_rate', 'high_fallback_rate') AND model_version = 'm0' THEN '_no_previous_good' ELSE '' END AS reason FROM (SELECT model_version, day, CASE WHEN n < 20 THEN 'insufficient_sample' WHEN round(e / n, 6) > 0.08 THEN 'high_error_rate' WHEN round(f / n, 6) > 0.42 THEN 'high_fallback_rate'
      WHEN p > 1500 THEN 'latency_breach' ELSE 'within_thresholds' END AS r FROM (SELECT model_version, strftime(created_at, '%Y-%m') AS day, count(*) AS n, sum(pipeline_error::INT) AS e, sum((fallback_state <> 'healthy')::INT) AS f,
      list_sort(list(total_latency_ms))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p FROM rm GROUP BY 1, 2))""")),
    "promotion_decision": (promotion_decision, sql("rm", """SELECT returned_count, CASE WHEN r = 'offline_metrics_passed' THEN 'approve' ELSE 'block' END AS decision, r AS reason FROM (SELECT returned_count, CASE WHEN a < 0.38 THEN 'recall_below_minimum' WHEN 0.42::DOUBLE - a > 0.01::DOUBLE THEN 'recall_regression'
      WHEN 0.09::DOUBLE - b > 0.02::DOUBLE THEN 'mrr_regression' ELSE 'offline_metrics_passed' END AS r FROM (SELECT returned_count, round(sum((fallback_state <> 'healthy')::INT) / count(*), 6) AS a, round(sum(pipeline_error::INT) / count(*), 6) AS b FROM rm GROUP BY 1))""")),
    "activation_gate": (activation_gate, sql("rm", """SELECT metric_id, CASE WHEN metric_id % 3 = 2 THEN metric_id % 5 = 0 ELSE NOT (metric_id % 4 = 0 AND model_version <> 'm1') END AS activated, CASE WHEN metric_id % 3 = 2 THEN CASE WHEN metric_id % 5 = 0 THEN 'override' ELSE 'not_approved' END
      WHEN metric_id % 4 = 0 AND model_version <> 'm1' THEN 'version_mismatch' ELSE 'approved' END AS gate FROM rm""")),
    "model_version_transitions": (model_version_transitions, sql("rm", """SELECT model_version, activated_at, deactivated_at, CASE WHEN before <> model_version THEN before END AS parent, CASE WHEN deactivated_at IS NULL THEN 'active' ELSE 'previous' END AS status FROM (
      SELECT *, lead(activated_at) OVER w AS deactivated_at, lag(model_version) OVER w AS before FROM (SELECT model_version, min(created_at + to_seconds(metric_id % 50)) AS activated_at FROM rm GROUP BY model_version, created_at) WINDOW w AS (ORDER BY activated_at, model_version))""")),
    "hourly_rates": (hourly_rates, sql("plays", "SELECT date_trunc('hour', created_at) AS hour, round(count(*) FILTER (event_type = 'skip') / count(*), 4) AS skip_rate, round(count(*) FILTER (event_type = 'complete') / count(*), 4) AS completion_rate FROM plays WHERE playratio IS NOT NULL GROUP BY 1")),
    "hourly_volume": (hourly_volume, sql("plays", """SELECT date_trunc('hour', created_at) AS hour, count(*) AS n, 'playback' AS stream FROM plays GROUP BY 1 UNION ALL SELECT date_trunc('hour', created_at), count(*), 'skips' FROM plays WHERE event_type = 'skip' GROUP BY 1
      UNION ALL SELECT date_trunc('hour', created_at), count(*), 'late' FROM plays WHERE date_trunc('hour', updated_at) > date_trunc('hour', created_at) GROUP BY 1""")),
    "hourly_uniques": (hourly_uniques, sql("plays", "SELECT date_trunc('hour', created_at) AS hour, count(DISTINCT user_int_id) AS n_users, count(DISTINCT track_id) AS n_tracks, count(DISTINCT session_int_id) AS n_sessions FROM plays GROUP BY 1")),
    "skip_completion_ratio": (skip_completion_ratio, sql("plays", "SELECT round(count(*) FILTER (playratio < 0.2) / nullif(count(*), 0), 4) AS skip_ratio, round(count(*) FILTER (playratio >= 0.8) / nullif(count(*), 0), 4) AS completion_ratio FROM plays WHERE playratio IS NOT NULL")),
    "rejections": (rejections, sql("plays", "SELECT 'type' || (track_id % 3) AS kind, count(*) AS n, count(*) FILTER (created_at > TIMESTAMP '2024-01-29 23:59:00') AS n_last_day FROM plays WHERE playratio IS NULL GROUP BY 1")),
    "rejection_rate": (rejection_rate, sql("plays", "SELECT round(a / nullif(a + b, 0), 4) AS rejection_rate FROM (SELECT count(*) FILTER (playratio IS NULL) AS a, count(*) FILTER (playratio IS NOT NULL) AS b FROM plays)")),
    "like_rate": (like_rate, sql("plays", "SELECT round(count(*) FILTER (event_type = 'complete') / nullif(count(DISTINCT (session_int_id, track_id)), 0), 4) AS like_rate FROM plays")),
    "sessions_after_watermark": (sessions_after_watermark, sql("plays delta", "SELECT count(DISTINCT session_int_id) AS n_sessions, count(DISTINCT session_int_id) FILTER (session_int_id > (SELECT coalesce(max(session_id), 0) FROM delta)) AS n_beyond FROM plays")),
    "latest_rollup": (latest_rollup, sql("rm", "SELECT metric_id, created_at, total_latency_ms FROM rm ORDER BY created_at DESC NULLS LAST, metric_id LIMIT 1")),
    "recent_decisions": (recent_decisions, sql("rm", "SELECT metric_id, created_at, fallback_state FROM rm WHERE pipeline_error ORDER BY created_at DESC NULLS LAST, metric_id LIMIT 5")),
    "fallback_state_counts": (fallback_state_counts, sql("rm", "SELECT fallback_state, count(*) AS n FROM rm GROUP BY 1")),
    "latency_summary": (latency_summary, sql("rm", """SELECT endpoint, count(*) AS n, median(total_latency_ms) AS p50, avg(total_latency_ms) AS "avg", min(total_latency_ms) AS least, max(total_latency_ms) AS most, round(avg(pipeline_error::INT), 4) AS error_rate,
      round(avg((fallback_state <> 'healthy')::INT), 4) AS fallback_rate, list_sort(list(total_latency_ms))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95, list_sort(list(total_latency_ms))[round_even(0.99::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p99
      FROM (SELECT CASE WHEN metric_id % 2 = 0 THEN 'bootstrap' ELSE 'next' END AS endpoint, * FROM rm UNION ALL SELECT 'combined', * FROM rm) GROUP BY 1""")),
    "trailing_rollups": (trailing_rollups, sql("plays", """SELECT window_name, n AS n_events, f AS finalized_count, CASE WHEN f = 0 THEN 0 ELSE round(c / f, 6) END AS completion_rate, CASE WHEN f = 0 THEN 0 ELSE round(s / f, 6) END AS skip_rate, 0.0::DOUBLE AS stream_failure_rate FROM (
      SELECT window_name, count(*) AS n, count(*) FILTER (fin) AS f, count(*) FILTER (fin AND event_type = 'skip') AS s, count(*) FILTER (fin AND (event_type = 'complete' OR coalesce(playratio, 0) >= 0.8)) AS c FROM (SELECT *, event_type IN ('skip', 'complete') OR playratio IS NOT NULL AS fin FROM plays),
      (VALUES ('5m', INTERVAL 5 MINUTE), ('1h', INTERVAL 1 HOUR), ('1d', INTERVAL 1 DAY)) w(window_name, len) WHERE created_at >= TIMESTAMP '2024-01-15' - len AND created_at <= TIMESTAMP '2024-01-15' GROUP BY 1)""")),
    "recent_tracks_50": (lambda s, d: e.recent_tracks(v.plays(s, d)), sql("plays", """SELECT session_int_id, track_id, place::INTEGER AS place FROM (SELECT session_int_id, track_id, row_number() OVER (PARTITION BY session_int_id ORDER BY last_at DESC, id DESC) AS place
      FROM (SELECT session_int_id, track_id, max(created_at) AS last_at, max_by(event_id, (created_at, event_id)) AS id FROM plays GROUP BY 1, 2)) WHERE place <= 50""")),
    "recommended_500": (lambda s, d: e.recommended_tracks(v.plays(s, d)), sql("plays", """SELECT session_int_id, track_id, place::INTEGER AS place FROM (SELECT session_int_id, track_id, row_number() OVER (PARTITION BY session_int_id ORDER BY last_at DESC, id DESC) AS place
      FROM (SELECT session_int_id, track_id, max(created_at) AS last_at, max_by(event_id, (created_at, event_id)) AS id FROM plays GROUP BY 1, 2)) WHERE place <= 500""")),
    "event_lifecycle": (lambda s, d: e.lifecycle(e.lifecycle_events(v.plays(s, d))), sql("plays", "SELECT event_id, created_at, updated_at, playratio, event_type FROM plays WHERE event_type <> 'playback_start'")),
    "stream_dedup": (e.stream_dedup_query, """SELECT (props->>'$.k')::BIGINT AS track_id, user_id, event_type FROM events GROUP BY ALL"""),
    "stream_hourly": (e.stream_hourly_query, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
