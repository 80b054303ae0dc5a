"""Queries that write files and read them back, and joint reports. QUERIES: name to (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import export as x
from cadenza.operators import features as f
from cadenza.operators import monitoring as m
from cadenza.operators import recall as rec
from cadenza.operators import sinks as k
from cadenza.plans import features as feature_plans
from cadenza.plans.oracle_views import sql
from cadenza.sources import files as r
from cadenza.sources import views as v
from cadenza.streaming import events as e

LAST, CUTOFF, NEXT_CUTOFF = "2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-25 00:00:00"
# The files that a serving bundle must have, and words that its names must not have.
BUNDLE_FILES = ["gru_ranker.pt", "gru_ranker_config.json", "cooc_session.npz", "cooc_playlist.npz", "user_centroids.pkl", "pop_scores.csv", "manifest.json"]
FORBIDDEN = ["faiss", ".index"]
DIMENSIONS = 64
#: Track ids in the range of one JSON document: the bound of what a group collects.
PER_DOCUMENT = 1000


def popularity_csv(s: SparkSession, d: str) -> DataFrame:
    path = f"{e.folder(s)}/popularity"
    k.write_csv(f.popularity(v.session_tracks(s, d)).select("track_id", "track_count", "pop_score"), path)
    return r.csv_columns(s, path, "track_id bigint, track_count bigint, pop_score double", ["track_id", "track_count"])


def manifest_csv(s: SparkSession, d: str) -> DataFrame:
    path = f"{e.folder(s)}/manifest"
    rows = v.catalog(s, d).select(
        F.when(F.col("track_id") % 3 == 0, F.concat(F.lit("t"), "track_id")).alias("song_id"),
        F.when(F.col("track_id") % 5 > 0, F.concat(F.lit("a.b/f"), "track_id", F.lit(".tar.mp3"))).alias("filename"),
        F.when(F.col("track_id") % 4 > 0, F.col("title")).alias("name"),
        F.when(F.col("track_id") % 7 > 0, F.col("artist")).otherwise(F.lit("  ")).alias("creator"),
        F.col("duration_sec").alias("seconds"),
    )
    k.write_csv(rows, path)
    return r.manifest(s, path)


def tracks_json(s: SparkSession, d: str) -> DataFrame:
    path = f"{e.folder(s)}/tracks"
    some = v.catalog(s, d).groupBy("artist", F.floor(F.col("track_id") / PER_DOCUMENT).alias("part"))
    k.write_json(some.agg(F.collect_list(F.struct("track_id", "title")).alias("tracks")).select("artist", "tracks"), path)
    rows = s.read.schema("artist string, tracks array<struct<track_id:bigint,title:string>>").json(path)
    return rows.select("artist", F.inline("tracks"))


def track_index_map(s: SparkSession, d: str) -> DataFrame:
    path = f"{e.folder(s)}/track-to-row"
    some = v.catalog(s, d).groupBy(F.floor(F.col("track_id") / PER_DOCUMENT).alias("part"))
    maps = some.agg(F.map_from_entries(F.collect_list(F.struct(F.col("track_id").cast("string"), F.col("duration_sec")))).alias("m"))
    maps.select(F.to_json("m")).write.text(path)
    return r.json_map(s.read.text(path), "value")


def versioned_export(s: SparkSession, d: str) -> DataFrame:
    """Two windows exported, the first of them twice, and the checkpoints that remain."""
    root, plays = f"{e.folder(s)}/export", v.plays(s, d)
    for version, last, cutoff in (("v1", LAST, CUTOFF), ("v1", LAST, CUTOFF), ("v2", CUTOFF, NEXT_CUTOFF)):
        rows = x.delta(plays, last, cutoff)
        outputs = {"session_tracks": rows, "session_meta": x.session_meta(rows), "users": v.users(s, d), "love": v.loved_tracks(s, d)}
        k.export_version(outputs | {"playlist_tracks": v.playlist_tracks(s, d)}, root, version)
    return k.checkpoints(s, root)


def export_listing(s: SparkSession, d: str) -> DataFrame:
    """The artists' folders of a catalogue that was written by artist, from the names of its files, with the tracks in each."""
    root = f"{e.folder(s)}/catalog"
    v.catalog(s, d).select("artist", "track_id", "title").repartition("artist").write.partitionBy("artist").option("header", True).csv(root)
    folder = F.element_at(F.split("path", "/"), -2)
    names = r.listing(s, root, (".csv",)).select(F.url_decode(F.regexp_replace(folder, "^artist=", "")).alias("artist")).distinct()
    rows = s.read.schema("track_id bigint, title string, artist string").option("header", True).csv(root)
    return names.join(rows.groupBy("artist").agg(F.count(F.lit(1)).alias("n_tracks")), "artist", "left")


def snapshot_and_deltas(s: SparkSession, d: str) -> DataFrame:
    base = v.catalog(s, d).select("track_id", "title")
    first = base.where("track_id % 3 = 0").withColumn("title", F.upper("title"))
    second = base.where("track_id % 6 = 0").select((F.col("track_id") * 2).alias("track_id"), F.lit("new").alias("title"))
    return k.with_deltas(base, [first, second], ["track_id"])


def manifest_status(s: SparkSession, d: str) -> DataFrame:
    tracks = v.catalog(s, d).select("track_id", "nav_id")
    own = tracks.select("track_id", F.when(F.col("track_id") % 2 == 0, F.col("nav_id")).otherwise("").alias("nav_id"))
    bulk = tracks.where("track_id % 5 = 0").select("track_id", F.concat(F.lit("bulk_"), "track_id").alias("nav_id"))
    return k.manifest_status(own, bulk, tracks.where("track_id % 3 > 0"))


def manifest_gaps(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    names = F.array(*[F.when(key % (i + 2) > 0, F.concat(F.lit("out/"), F.lit(n))) for i, n in enumerate(BUNDLE_FILES)], F.when(key % 11 == 0, "x/TRACKS.Index"))
    return k.manifest_gaps(v.table(s, d, "part").select(key.alias("version"), F.array_compact(names).alias("files")), BUNDLE_FILES, FORBIDDEN)


def vectors_or_zero(s: SparkSession, d: str) -> DataFrame:
    tracks = v.catalog(s, d).select((F.col("track_id") * 3).alias("track_id"))
    return f.vector_or_zero(tracks, v.embeddings(s, d), "track_id", DIMENSIONS)


def _window(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", F.col("created_at") - F.make_ym_interval(F.lit(28)))


def joint_rollup(s: SparkSession, d: str) -> DataFrame:
    key = F.col("metric_id")
    requests = v.request_metrics(s, d).withColumns(
        {
            "artist": F.when(key % 4 > 0, F.concat(F.lit("artist "), key % 7)),
            "track_ids": F.array(key % 5, F.col("returned_count")),
            "error_code": F.when(key % 17 == 0, "timeout").otherwise(""),
            "fallback_level": F.when(key % 13 == 0, "popular").otherwise("none"),
        }
    )
    plays = _window(v.plays(s, d))
    feedback = plays.select("created_at", F.when(F.col("track_id") % 3 == 0, "dislike").otherwise("like").alias("feedback_type"))
    return m.joint_rollup(requests, plays, feedback, "1d", "1996-01-10 00:00:00", "1996-01-20 00:00:00")


def rejections_by_hour(s: SparkSession, d: str) -> DataFrame:
    rejected = v.plays(s, d).where("playratio IS NULL")
    return rejected.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("rejections"))


def latency_series(s: SparkSession, d: str) -> DataFrame:
    days = v.request_metrics(s, d).withColumn("day", F.date_trunc("day", "created_at").cast("timestamp_ntz"))
    return m.request_rollup(days, ["day"]).select("day", "p95_latency_ms", "error_rate", "fallback_rate")


def recent_exports(s: SparkSession, d: str) -> DataFrame:
    """The ten exports recorded last, of all that ended well."""
    rows = v.request_metrics(s, d).where("NOT pipeline_error")
    return rows.select("metric_id", "returned_count", "created_at").orderBy(F.desc("created_at"), F.desc("metric_id")).limit(10)


def successful_exports(s: SparkSession, d: str) -> DataFrame:
    return v.request_metrics(s, d).agg(F.count(F.when(~F.col("pipeline_error"), 1)).alias("n_exports"))


def active_model(s: SparkSession, d: str) -> DataFrame:
    """The version activated last, none if there is none, and its degradation as 0 or 1."""
    rows = v.request_metrics(s, d).where("fallback_state = 'model_degraded'")
    last = F.max(F.struct("created_at", "metric_id", "model_version", "pipeline_error")).alias("l")
    return rows.agg(last).select(F.coalesce("l.model_version", F.lit("none")).alias("model_version"), F.coalesce(F.col("l.pipeline_error").cast("int"), F.lit(0)).alias("degraded"))


def open_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions that are neither expired nor revoked on a day."""
    rows = v.request_metrics(s, d).select("metric_id", (F.col("created_at") + F.expr("INTERVAL 14 DAYS")).alias("expires_at"), "pipeline_error")
    return rows.where((F.col("expires_at") > F.lit("1996-06-01").cast("timestamp_ntz")) & ~F.col("pipeline_error")).select("metric_id", "expires_at")


def centroid_or_zero(s: SparkSession, d: str) -> DataFrame:
    """All users with the mean vector of their taste, zeros for cold ones."""
    values = feature_plans.user_mean_centroid(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    known = values.select("user_id", F.col("v.value").alias("embedding"))
    return f.vector_or_zero(v.table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), known, "user_id", DIMENSIONS)


def unseen_tracks(s: SparkSession, d: str) -> DataFrame:
    """For each session the tracks of its user's sessions that it neither played (50) nor was shown (500) lately and its user does not dislike."""
    plays = v.plays(s, d)
    of_user = plays.select("user_int_id", "track_id").distinct()
    candidates = plays.select("session_int_id", "user_int_id").distinct().join(of_user, "user_int_id").select("session_int_id", "user_int_id", "track_id")
    disliked = plays.where("event_type = 'skip' AND track_id % 2 = 0").select("user_int_id", "track_id")
    shown = e.recommended_tracks(plays.withColumn("track_id", F.col("track_id") + 1))
    return rec.excluding(candidates, [(e.recent_tracks(plays), ["session_int_id"]), (shown, ["session_int_id"]), (disliked, ["user_int_id"])])


def plays_by_event_time(s: SparkSession, d: str) -> DataFrame:
    """Plays by the hour at which they count, with those that began in an earlier one."""
    plays = v.plays(s, d).withColumn("at", x.event_time())
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    return plays.groupBy(hour("at").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hour("created_at") < hour("at"), 1)).alias("n_earlier"))


ZEROS = f"list_resize([]::DOUBLE[], {DIMENSIONS}, 0.0::DOUBLE)"
GAPS = ", ".join(f"CASE WHEN p_partkey % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate(BUNDLE_FILES))
P95 = "list_sort(list(total_latency_ms))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1]"
JOINT = """
, q AS (
  SELECT *, CASE WHEN metric_id % 4 > 0 THEN 'artist ' || (metric_id % 7) END AS artist, metric_id % 5 = returned_count AS repeated,
    pipeline_error OR metric_id % 17 = 0 AS failed, fallback_state <> 'healthy' OR metric_id % 13 = 0 AS fell
  FROM rm WHERE created_at BETWEEN TIMESTAMP '1996-01-10' AND TIMESTAMP '1996-01-20'
), p AS (
  SELECT *, event_type IN ('skip', 'complete') OR playratio IS NOT NULL AS fin FROM plays
  WHERE created_at - INTERVAL 28 YEAR BETWEEN TIMESTAMP '1996-01-10' AND TIMESTAMP '1996-01-20'
), a AS (
  SELECT count(*) AS n, count(*) FILTER (failed) AS e, count(*) FILTER (fell) AS f, count(*) FILTER (fallback_state = 'catalog_insufficient') AS cat,
    count(*) FILTER (repeated) AS rep, avg(returned_count) AS ret, list_sort(list(total_latency_ms)) AS ls FROM q
), b AS (
  SELECT count(*) AS n_plays, count(*) FILTER (fin) AS n_fin, count(*) FILTER (fin AND event_type = 'skip') AS n_skip,
    count(*) FILTER (fin AND (event_type = 'complete' OR playratio >= 0.8)) AS n_complete, count(*) FILTER (track_id % 3 = 0) AS n_dislike FROM p
), artists AS (
  SELECT max(c) AS top, sum(c) AS total FROM (SELECT artist, count(*) AS c FROM q WHERE artist IS NOT NULL GROUP BY 1)
), models AS (
  SELECT model_version FROM q GROUP BY 1 ORDER BY count(*) DESC, min((created_at, metric_id)) LIMIT 1
)
SELECT '1d' AS window_name, n AS request_count, cat AS catalog_failure_count, rep AS repeat_violation_count, CASE WHEN n > 0 THEN round(e / n, 6) ELSE 0 END AS error_rate,
  CASE WHEN n > 0 THEN round(f / n, 6) ELSE 0 END AS fallback_rate, coalesce(ret, 0) AS avg_returned_count,
  coalesce(ls[round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT + 1], 0) AS p50_latency_ms, coalesce(ls[round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT + 1], 0) AS p95_latency_ms,
  coalesce(round(top / total, 6), 0) AS top_artist_share, (SELECT model_version FROM models) AS model_version,
  CASE WHEN n >= 20 THEN 'ok' ELSE 'insufficient' END AS sample_status, n_fin AS finalized_playback_count, n_plays AS feedback_count, 0 AS stream_failure_count,
  CASE WHEN n_fin > 0 THEN round(n_complete / n_fin, 6) ELSE 0 END AS completion_rate, CASE WHEN n_fin > 0 THEN round(n_skip / n_fin, 6) ELSE 0 END AS skip_rate,
  round(n_dislike / greatest(n, 1), 6) AS dislike_rate, 0.0 AS stream_failure_rate
FROM a, b, artists
"""
EXPORTED = """
SELECT version, 'success' AS status, count(session_int_id) AS session_tracks_rows, coalesce(max(session_int_id), 0) AS session_int_id_watermark
FROM (VALUES ('v1', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20'), ('v2', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-25')) AS w(version, low, high)
LEFT JOIN plays ON playratio IS NOT NULL AND created_at > low AND created_at <= high GROUP BY 1
"""
MANIFEST = """
SELECT track_id, coalesce(title, track_id) AS title, artist, '' AS album, duration_sec::DOUBLE AS duration_sec, '/covers/' || track_id AS cover_art_url
FROM (
  SELECT CASE WHEN track_id % 3 = 0 THEN 't' || track_id WHEN track_id % 5 > 0 THEN 'f' || track_id || '.tar' END AS track_id,
    CASE WHEN track_id % 4 > 0 THEN title END AS title, CASE WHEN track_id % 7 > 0 THEN artist ELSE 'Unknown Artist' END AS artist, duration_sec
  FROM cat
) WHERE track_id IS NOT NULL
"""
STATUS = """
SELECT track_id, nav_id, CASE WHEN nav_id IS NULL THEN CASE WHEN known THEN 'verified' ELSE 'missing' END WHEN stored = nav_id THEN 'verified' ELSE 'remap' END AS status
FROM (
  SELECT track_id, CASE WHEN track_id % 5 = 0 THEN 'bulk_' || track_id WHEN track_id % 2 = 0 THEN nav_id END AS nav_id, track_id % 3 > 0 AS known,
    CASE WHEN track_id % 3 > 0 THEN nav_id END AS stored
  FROM cat
)
"""
SNAPSHOT = """
SELECT track_id, title FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY turn DESC) AS r FROM (
    SELECT track_id, title, 0 AS turn FROM cat UNION ALL SELECT track_id, upper(title), 1 FROM cat WHERE track_id % 3 = 0
    UNION ALL SELECT track_id * 2, 'new', 2 FROM cat WHERE track_id % 6 = 0
  )
) WHERE r = 1
"""
UNSEEN = """, candidate AS (
  SELECT DISTINCT s.session_int_id, s.user_int_id, p.track_id FROM (SELECT DISTINCT session_int_id, user_int_id FROM plays) s JOIN plays p USING (user_int_id)
), newest AS (
  SELECT session_int_id, track_id, row_number() OVER (PARTITION BY session_int_id ORDER BY last DESC) AS place
  FROM (SELECT session_int_id, track_id, max((created_at, event_id)) AS last FROM plays GROUP BY 1, 2)
)
SELECT session_int_id, user_int_id, track_id FROM candidate c
WHERE NOT EXISTS (SELECT 1 FROM plays x WHERE x.event_type = 'skip' AND x.track_id % 2 = 0 AND x.user_int_id = c.user_int_id AND x.track_id = c.track_id)
  AND NOT EXISTS (SELECT 1 FROM newest y WHERE y.place <= 50 AND y.session_int_id = c.session_int_id AND y.track_id = c.track_id)
  AND NOT EXISTS (SELECT 1 FROM newest y WHERE y.place <= 500 AND y.session_int_id = c.session_int_id AND y.track_id + 1 = c.track_id)
"""

EVENT_TIME = """SELECT date_trunc('hour', at_) AS hour, count(*) AS n, count(*) FILTER (date_trunc('hour', created_at) < date_trunc('hour', at_)) AS n_earlier
FROM (SELECT *, CASE WHEN event_type IN ('skip', 'complete') OR playratio IS NOT NULL THEN coalesce(updated_at, created_at) ELSE created_at END AS at_ FROM plays) GROUP BY 1"""

QUERIES = {
    "popularity_csv": (popularity_csv, sql("pop", "SELECT track_id, track_count FROM pop")),
    "manifest_csv": (manifest_csv, sql("cat", MANIFEST)),
    "tracks_json": (tracks_json, sql("cat", "SELECT artist, track_id, title FROM cat")),
    "track_index_map": (track_index_map, sql("cat", "SELECT track_id::VARCHAR AS key, duration_sec AS value FROM cat")),
    "versioned_export": (versioned_export, sql("plays", EXPORTED)),
    "export_listing": (export_listing, sql("cat", "SELECT artist, count(*) AS n_tracks FROM cat GROUP BY 1")),
    "snapshot_and_deltas": (snapshot_and_deltas, sql("cat", SNAPSHOT)),
    "manifest_status": (manifest_status, sql("cat", STATUS)),
    "manifest_gaps": (
        manifest_gaps,
        f"""SELECT version, missing, forbidden, len(missing) = 0 AND NOT forbidden AS valid FROM (
          SELECT p_partkey AS version, list_sort(list_filter([{GAPS}], lambda x: x IS NOT NULL)) AS missing, p_partkey % 11 = 0 AS forbidden FROM part)""",
    ),
    "vectors_or_zero": (
        vectors_or_zero,
        sql(
            "cat emb",
            f"""SELECT cat.track_id * 3 AS track_id, coalesce(embedding::DOUBLE[], {ZEROS}) AS vector, embedding IS NOT NULL AS known
              FROM cat LEFT JOIN emb ON emb.track_id = cat.track_id * 3""",
        ),
    ),
    "centroid_or_zero": (
        centroid_or_zero,
        f"""WITH m AS ({feature_plans.QUERIES["user_mean_centroid"][1]}), c AS (SELECT user_id, list(value ORDER BY dim) AS v FROM m GROUP BY 1)
          SELECT c_custkey AS user_id, coalesce(v::DOUBLE[], {ZEROS}) AS vector, v IS NOT NULL AS known FROM customer LEFT JOIN c ON user_id = c_custkey""",
    ),
    "joint_rollup": (joint_rollup, sql("rm plays", "SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + JOINT),
    "rejections_by_hour": (
        rejections_by_hour,
        sql("plays", "SELECT date_trunc('hour', created_at) AS hour, event_type, count(*) AS rejections FROM plays WHERE playratio IS NULL GROUP BY 1, 2"),
    ),
    "latency_series": (
        latency_series,
        sql(
            "rm",
            f"""SELECT date_trunc('day', created_at)::TIMESTAMP AS day, {P95} AS p95_latency_ms, round(count(*) FILTER (pipeline_error) / count(*), 6) AS error_rate,
              round(count(*) FILTER (fallback_state <> 'healthy') / count(*), 6) AS fallback_rate FROM rm GROUP BY 1""",
        ),
    ),
    "recent_exports": (
        recent_exports,
        sql("rm", "SELECT metric_id, returned_count, created_at FROM rm WHERE NOT pipeline_error ORDER BY created_at DESC, metric_id DESC LIMIT 10"),
    ),
    "successful_exports": (successful_exports, sql("rm", "SELECT count(*) FILTER (NOT pipeline_error) AS n_exports FROM rm")),
    "active_model": (
        active_model,
        sql(
            "rm",
            """SELECT coalesce(arg_max(model_version, (created_at, metric_id)), 'none') AS model_version,
              coalesce(arg_max(pipeline_error, (created_at, metric_id))::INTEGER, 0) AS degraded FROM rm WHERE fallback_state = 'model_degraded'""",
        ),
    ),
    "open_sessions": (
        open_sessions,
        sql(
            "rm",
            """SELECT metric_id, created_at + INTERVAL 14 DAY AS expires_at FROM rm
              WHERE created_at + INTERVAL 14 DAY > TIMESTAMP '1996-06-01' AND NOT pipeline_error""",
        ),
    ),
    "unseen_tracks": (unseen_tracks, sql("plays", "").rstrip() + UNSEEN),
    "plays_by_event_time": (plays_by_event_time, sql("plays", EVENT_TIME)),
}
