"""Queries over catalogue maintenance: search, lookups, adaptive updates, records. QUERIES: name to (query, DuckDB SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import search
from cadenza.operators import tables as t
from cadenza.plans.oracle_views import sql
from cadenza.sources import views as v
from cadenza.streaming import events as e
from cadenza.streaming import lookup

#: Columns that an update fills where the table has them, from the match's columns.
SOURCES = {
    "title": "title",
    "artist": "artist",
    "album": "album",
    "album_artist": "artist",
    "order_artist_name": "lower(artist)",
    "full_text": "title || ' ' || album || ' ' || artist || ' ' || artist",
}


def term_search(s: SparkSession, d: str) -> DataFrame:
    """Tracks looked up by id, then title (some are not in the catalogue), then artist and kind."""
    songs = v.catalog(s, d).select(
        F.concat(F.lit("nav"), F.col("track_id")).alias("id"), "title", F.concat(F.lit("music/"), F.col("album"), F.lit("/"), F.col("track_id"), F.lit(".mp3")).alias("path"), "album", "artist"
    )
    key = F.col("track_id")
    title = F.when(key % 4 == 0, F.concat("title", F.lit(" unknown"))).when(key % 4 == 1, F.lit("")).otherwise(F.col("title"))
    terms = F.array(F.concat(F.lit("t"), key), F.when(key % 3 == 0, F.concat(F.lit("nav"), key)).otherwise(title), F.concat_ws(" ", "artist", "album"))
    rows = v.catalog(s, d).select(key.cast("string").alias("track_id"), terms.alias("terms"))
    return search.term_search(rows, songs)


def stream_lookup(s: SparkSession, d: str) -> DataFrame:
    """Events that name a track of another service, by a stream joined with the mapping; unknown names stay without a track."""
    own = e.folder(s)
    events = e.read_events(s, d).select("event_id", F.concat(F.lit("nav_"), F.get_json_object("props", "$.k").cast("bigint") * 7).alias("nav_id"))
    mapping = v.catalog(s, d).where("nav_id IS NOT NULL").select("nav_id", "track_id")
    return e.write_once(lookup.with_tracks(events, mapping), f"{own}/out", f"{own}/state").select("event_id", "nav_id", "track_id")


def adaptive_update(s: SparkSession, d: str) -> DataFrame:
    """A media table without the columns album and order_artist_name, updated by what the session's catalogue says it has."""
    tracks = v.catalog(s, d)
    name = f"media_{uuid.uuid4().hex}"
    key = F.col("track_id")
    media = tracks.select(
        key.alias("media_id"),
        F.when(key % 3 == 0, F.concat(F.lit("f/"), key)).otherwise(F.concat(F.lit("x/"), key)).alias("path"),
        F.when(key % 5 == 0, (key + 1).cast("string")).otherwise("untitled").alias("title"),
        F.lit("unknown").alias("artist"),
        F.lit(None).cast("string").alias("full_text"),
    )
    media.createOrReplaceTempView(name)
    known = tracks.where("track_id % 2 = 0 OR track_id % 3 = 0")
    metadata = known.select(F.concat(F.lit("f/"), key).alias("filename"), key.cast("string").alias("track_key"), "title", "artist", "album")
    try:
        return t.updated_from_matches(s, name, metadata, SOURCES)
    finally:
        s.catalog.dropTempView(name)


def track_records(s: SparkSession, d: str) -> DataFrame:
    """The API record of every track, as JSON, its title cut to 12 characters."""
    return t.track_records(v.catalog(s, d))


def recent_requests(s: SparkSession, d: str) -> DataFrame:
    """Requests by optional conditions: a state is asked for, a version is not."""
    return t.where_given(v.request_metrics(s, d), {"fallback_state": "model_degraded", "model_version": None}).select("metric_id", "model_version", "fallback_state")


def dev_sample(s: SparkSession, d: str) -> DataFrame:
    """The sessions of a development run: the first thousand by id, whole."""
    return t.first_keys(v.session_tracks(s, d).select("session_id", "position", "track_id"), "session_id", 1000)


TERMS = """, song AS (
  SELECT 'nav' || track_id AS id, lower(concat_ws(' ', 'nav' || track_id, title, 'music/' || album || '/' || track_id || '.mp3', album, artist)) AS haystack FROM cat
), indexed AS (
  SELECT id, haystack, list_filter(regexp_split_to_array(haystack, '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM song
), asked AS (
  SELECT track_id::VARCHAR AS track_id, unnest([0, 1, 2]) AS place, unnest(['t' || track_id, CASE WHEN track_id % 3 = 0 THEN 'nav' || track_id
    WHEN track_id % 4 = 0 THEN title || ' unknown' WHEN track_id % 4 = 1 THEN '' ELSE title END, artist || ' ' || album]) AS term FROM cat
), term AS (
  SELECT term, list_distinct(list_filter(regexp_split_to_array(lower(term), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS words FROM (SELECT DISTINCT term FROM asked WHERE trim(term) <> '')
), posting AS (
  SELECT DISTINCT id, unnest(words) AS word FROM indexed
), hit AS (
  SELECT term.term, posting.id FROM (SELECT term, unnest(words) AS word, len(words) AS n FROM term) term JOIN posting USING (word) GROUP BY term.term, posting.id HAVING count(*) = any_value(n)
), first_ AS (
  SELECT track_id, arg_min(term, place) AS term FROM asked WHERE term IN (SELECT term FROM hit) GROUP BY track_id
), best AS (
  SELECT f.track_id, f.term, min((NOT contains(indexed.haystack, lower(f.track_id)), hit.id)) AS b FROM first_ f JOIN hit USING (term) JOIN indexed ON indexed.id = hit.id GROUP BY ALL
)
SELECT cat.track_id::VARCHAR AS track_id, best.term, best.b[2] AS song_id, NOT best.b[1] AS marked FROM cat LEFT JOIN best ON best.track_id = cat.track_id::VARCHAR"""

LOOKUP = """SELECT event_id, 'nav_' || ((props->>'$.k')::BIGINT * 7) AS nav_id, cat.track_id
FROM events LEFT JOIN cat ON cat.nav_id = 'nav_' || ((props->>'$.k')::BIGINT * 7)"""

ADAPTIVE = """, media AS (
  SELECT track_id AS media_id, CASE WHEN track_id % 3 = 0 THEN 'f/' || track_id ELSE 'x/' || track_id END AS path,
    CASE WHEN track_id % 5 = 0 THEN (track_id + 1)::VARCHAR ELSE 'untitled' END AS title FROM cat
), meta AS (
  SELECT 'f/' || track_id AS filename, track_id::VARCHAR AS track_key, title, artist, album FROM cat WHERE track_id % 2 = 0 OR track_id % 3 = 0
), both_ AS (
  SELECT media_id, path, media.title AS old, a.title AS a_title, a.artist AS a_artist, a.album AS a_album, b.title AS b_title, b.artist AS b_artist, b.album AS b_album
  FROM media LEFT JOIN meta a ON a.filename = media.path LEFT JOIN meta b ON b.track_key = CASE WHEN a.title IS NOT NULL THEN a.title ELSE media.title END
)
SELECT media_id, path, coalesce(b_title, a_title, old) AS title, coalesce(b_artist, a_artist, 'unknown') AS artist,
  coalesce(b_title || ' ' || b_album || ' ' || b_artist || ' ' || b_artist, a_title || ' ' || a_album || ' ' || a_artist || ' ' || a_artist) AS full_text
FROM both_"""

RECORDS = """SELECT track_id, '{"track_id":"' || track_id || '","title":"' || CASE WHEN length(title) > 12 THEN left(title, 11) || '…' ELSE title END || '","artist":"' || artist
  || '","playable":' || (is_playable AND availability_status = 'available')::VARCHAR || '}' AS record FROM cat"""

QUERIES = {
    "term_search": (term_search, sql("cat", "").rstrip() + TERMS),
    "stream_lookup": (stream_lookup, sql("cat", LOOKUP)),
    "adaptive_update": (adaptive_update, sql("cat", "").rstrip() + ADAPTIVE),
    "track_records": (track_records, sql("cat", RECORDS)),
    "recent_requests": (recent_requests, sql("rm", "SELECT metric_id, model_version, fallback_state FROM rm WHERE fallback_state = 'model_degraded'")),
    "dev_sample": (dev_sample, sql("st", """SELECT session_id, position::INTEGER AS position, track_id FROM st
      WHERE session_id IN (SELECT DISTINCT session_id FROM st ORDER BY session_id LIMIT 1000)""")),
}
