"""Queries over stateful streams, each fed in several arrivals with a restart in between. QUERIES: name to (query, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import sinks as k
from cadenza.plans.oracle_views import sql
from cadenza.sources import views as v
from cadenza.streaming import events as e
from cadenza.streaming import state as st

#: Lists are read at this time: those of the first half of the month have ended.
READ = "2024-01-31 00:00:00"
CUTS = ["2024-01-08 12:00:00", "2024-01-21 00:00:00"]


def _streamed(s: SparkSession, rows: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that `operator` sends out for `rows` (with the time `at`), which come in three parts; the stream starts anew for each."""
    own = e.folder(s)

    def run() -> None:
        e.write_once(operator(s.readStream.schema(rows.schema).parquet(f"{own}/in")), f"{own}/out", f"{own}/state")

    with e.rocksdb(s):
        st.arrive(rows, "at", CUTS, f"{own}/in", run)
    return s.read.parquet(f"{own}/out")


def _plain(*columns: str) -> list:
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


def stream_lifecycle(s: SparkSession, d: str) -> DataFrame:
    """Starts and ends; the starts of every eleventh track never came in, so their ends are lost."""
    plays = v.plays(s, d)
    events = e.lifecycle_events(plays).join(plays.select("event_id", "track_id"), "event_id")
    events = events.where("phase = 'end' OR track_id % 11 <> 3").drop("track_id").withColumn("at", F.col("at").cast("timestamp"))
    merged = st.latest_plays(_streamed(s, events, lambda x: st.merged_plays(x, keep=60)))
    return merged.select("kind", "event_id", *_plain("created_at", "updated_at"), "playratio", "event_type")


def _visits(s: SparkSession, d: str) -> DataFrame:
    """Some sign-ups are logins, all other events plays, a fifth of which name their session."""
    raw = v.table(s, d, "events")
    login = (F.col("event_type") == "signup") & (F.col("event_id") % 8 == 0)
    own = F.when(~login & (F.col("event_id") % 5 == 0), F.concat(F.lit("own-"), F.col("event_id") % 7))
    return raw.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), F.when(login, "login").otherwise("play").alias("action"), own.alias("own_session"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    found = _streamed(s, _visits(s, d), lambda x: st.sticky_sessions(x, days=14))
    return found.select("event_id", "user_id", *_plain("at"), "session_id", *_plain("session_start"))


def _actions(s: SparkSession, d: str) -> DataFrame:
    """Every play of a session, and with it a call that recommends the track's three successors."""
    plays = v.plays(s, d).select(F.col("session_int_id").alias("session_id"), "event_id", F.col("created_at").cast("timestamp").alias("at"), "track_id")
    more = F.array(*[F.col("track_id") + i for i in (1, 2, 3)])
    both = F.array(F.struct(F.lit("played").alias("action"), F.array("track_id").alias("tracks")), F.struct(F.lit("recommended").alias("action"), more.alias("tracks")))
    return plays.select("session_id", "event_id", "at", F.explode(both).alias("x")).select("session_id", "event_id", "at", "x.action", "x.tracks")


def stream_track_lists(s: SparkSession, d: str) -> DataFrame:
    lists = st.latest_lists(_streamed(s, _actions(s, d), st.track_lists), READ)
    text = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), ",").alias(c)
    return lists.select("session_id", text("recent"), text("recommended"))


def stream_queue_revisions(s: SparkSession, d: str) -> DataFrame:
    """Every play writes its session's queue; every batch comes twice."""
    writes = _actions(s, d).where("action = 'recommended'").select("session_id", "event_id", "at", F.col("tracks").alias("items"))
    own = e.folder(s)
    table = st.QueueTable(s, f"{own}/queues", compact=2)

    def write(rows: DataFrame, batch: int) -> None:
        table.write(rows, batch)
        table.write(rows, batch)

    def run() -> None:
        stream = s.readStream.schema(writes.schema).parquet(f"{own}/in")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()

    st.arrive(writes, "at", CUTS, f"{own}/in", run)
    text = F.array_join(F.transform("items", lambda t: t.cast("string")), ",")
    return table.current().select("session_id", text.alias("items"), "revision", *_plain("at"))


def export_chained(s: SparkSession, d: str) -> DataFrame:
    """Plays come in three parts; each export begins where the one before it ended. All exported rows with their version."""
    plays = v.plays(s, d)
    own = e.folder(s)

    def run() -> None:
        stream = s.readStream.schema(plays.schema).parquet(f"{own}/in")
        history = lambda: s.read.schema(plays.schema).parquet(f"{own}/in")
        k.export_stream(stream, history, f"{own}/exports", f"{own}/state")

    st.arrive(plays, "created_at", CUTS, f"{own}/in", run)
    return k.exported(s, f"{own}/exports").select("session_id", "user_id", "position", "track_id", "playratio", "label", "version", "rows_of_version")


LIFECYCLE = """SELECT CASE WHEN track_id % 11 = 3 THEN 'lost' ELSE 'merged' END AS kind, event_id, CASE WHEN track_id % 11 <> 3 THEN created_at END AS created_at, updated_at,
  coalesce(playratio, 0.0) AS playratio, event_type
FROM plays WHERE event_type <> 'playback_start'"""

SESSIONS = """WITH RECURSIVE visit AS (
  SELECT event_id, user_id, ts AS seen, event_type = 'signup' AND event_id % 8 = 0 AS login FROM events
), sticky AS (
  SELECT *, sum(login::INT) OVER (PARTITION BY user_id ORDER BY seen, event_id) AS era FROM visit
), play AS (
  SELECT event_id, user_id, seen, era FROM sticky WHERE NOT login AND event_id % 5 <> 0
), begun AS (
  SELECT user_id, era, min(seen) AS start FROM play GROUP BY user_id, era
  UNION ALL
  SELECT b.user_id, b.era, (SELECT min(p.seen) FROM play p WHERE p.user_id = b.user_id AND p.era = b.era AND p.seen >= b.start + INTERVAL 14 DAY) AS start
  FROM begun b WHERE b.start IS NOT NULL
), assigned AS (
  SELECT play.event_id, play.user_id, play.seen, max(begun.start) AS start
  FROM play JOIN begun ON begun.user_id = play.user_id AND begun.era = play.era AND begun.start <= play.seen GROUP BY ALL
)
SELECT event_id, user_id, seen AS "at", user_id || '-' || epoch_us(start) AS session_id, start AS session_start FROM assigned
UNION ALL
SELECT event_id, user_id, seen, 'own-' || (event_id % 7), NULL FROM sticky WHERE NOT login AND event_id % 5 = 0"""

LISTS = f""", played AS (
  SELECT session_int_id AS session_id, track_id, max((created_at, event_id)) AS last FROM plays GROUP BY ALL
), recent AS (
  SELECT session_id, string_agg(track_id::VARCHAR, ',' ORDER BY last DESC) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last DESC) AS place FROM played) WHERE place <= 50 GROUP BY session_id
), shown AS (
  SELECT session_id, track_id, max((created_at, event_id, -k)) AS last
  FROM (SELECT session_int_id AS session_id, track_id + k AS track_id, created_at, event_id, k FROM plays, (VALUES (1), (2), (3)) AS v(k)) GROUP BY ALL
), recommended AS (
  SELECT session_id, string_agg(track_id::VARCHAR, ',' ORDER BY last DESC) AS recommended
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last DESC) AS place FROM shown) WHERE place <= 500 GROUP BY session_id
)
SELECT session_id, recent, CASE WHEN max(created_at) + INTERVAL 14 DAY > TIMESTAMP '{READ}' THEN any_value(recommended) ELSE '' END AS recommended
FROM recent JOIN recommended USING (session_id) JOIN plays ON session_int_id = session_id GROUP BY session_id, recent"""

REVISIONS = """SELECT session_int_id AS session_id, max_by((track_id + 1) || ',' || (track_id + 2) || ',' || (track_id + 3), (created_at, event_id)) AS items,
  1 + count(*) AS revision, max(created_at) AS "at"
FROM plays GROUP BY 1"""

CHAINED = f"""SELECT session_id, user_id, position::INTEGER AS position, track_id, playratio, label, version, count(*) OVER (PARTITION BY version) AS rows_of_version
FROM (SELECT session_int_id AS session_id, user_int_id AS user_id, row_number() OVER (PARTITION BY session_int_id ORDER BY created_at, event_id) - 1 AS position, track_id, playratio,
  CASE WHEN playratio > 0.8 THEN 'positive' WHEN playratio > 0.2 THEN 'neutral' ELSE 'skip' END AS label,
  CASE WHEN created_at <= TIMESTAMP '{CUTS[0]}' THEN '00000' WHEN created_at <= TIMESTAMP '{CUTS[1]}' THEN '00001' ELSE '00002' END AS version
  FROM plays WHERE playratio IS NOT NULL)"""

QUERIES = {
    "stream_lifecycle": (stream_lifecycle, sql("plays", LIFECYCLE)),
    "stream_sessions": (stream_sessions, SESSIONS),
    "stream_track_lists": (stream_track_lists, sql("plays", "").rstrip() + LISTS),
    "stream_queue_revisions": (stream_queue_revisions, sql("plays", REVISIONS)),
    "export_chained": (export_chained, sql("plays", CHAINED)),
}
