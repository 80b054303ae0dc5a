"""Queries over recorded rollups and the decisions made from them. QUERIES: name to (query, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import export as x
from cadenza.operators import monitoring as m
from cadenza.operators import tables as t
from cadenza.plans.oracle_views import sql
from cadenza.sources import views as v
from cadenza.sources.shared import stored

LIMITS = {"max_fallback_rate": 0.42, "max_error_rate": 0.2, "max_dislike_rate": 0.6, "max_p95_latency_ms": 9000.0, "max_top_artist_share": 0.2}


def _rollups(s: SparkSession, d: str) -> DataFrame:
    """The joint rollup of every month, as recorded; plays count in month number event_id % 80 from January 1992."""
    key = F.col("metric_id")
    requests = v.request_metrics(s, d).withColumns(
        {
            "window_name": F.date_format("created_at", "yyyy-MM"),
            "artist": F.when(key % 4 > 0, F.concat(F.lit("artist "), key % 7)),
            "track_ids": F.when(key % 97 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(key)),
        }
    )
    month = F.add_months(F.lit("1992-01-01").cast("date"), (F.col("event_id") % 80).cast("int"))
    plays = v.plays(s, d).withColumn("window_name", F.date_format(month, "yyyy-MM"))
    feedback = plays.select("window_name", F.when(F.col("track_id") % 3 == 0, "dislike").otherwise("like").alias("feedback_type"))
    windows = requests.select("window_name").distinct()
    windows = windows.withColumn("window_end", F.add_months(F.concat("window_name", F.lit("-01")).cast("date"), 1).cast("timestamp_ntz"))
    return stored(m.joint_rollups(requests, plays, feedback, windows), "rollups")


def _activations(s: SparkSession, d: str) -> DataFrame:
    """The first request of a version in each of its years stands for an activation."""
    year = F.year("created_at").alias("year")
    at = F.col("created_at") + F.make_dt_interval(secs=F.col("metric_id") % 50)
    return t.activations(v.request_metrics(s, d).groupBy("model_version", year).agg(F.min(at).alias("activated_at")))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    rolled = m.serving_models(_rollups(s, d), _activations(s, d), "window_end")
    return m.rollback_decision(rolled, LIMITS).select("window_name", "window_end", "decision", "reason", "active_version", "previous_version")


def monthly_rollups(s: SparkSession, d: str) -> DataFrame:
    return _rollups(s, d)


def rollup_decisions(s: SparkSession, d: str) -> DataFrame:
    return _decisions(s, d)


def outcome_series(s: SparkSession, d: str) -> DataFrame:
    return _rollups(s, d).select("window_end", "completion_rate", "skip_rate", "dislike_rate", "fallback_rate", "error_rate", "p95_latency_ms")


def last_rollups(s: SparkSession, d: str) -> DataFrame:
    return m.latest(_rollups(s, d).select("window_name", "window_end", "request_count", "fallback_rate", "error_rate", "sample_status"), "window_end", 5)


def last_rollbacks(s: SparkSession, d: str) -> DataFrame:
    return m.latest(_decisions(s, d).where("decision <> 'no_action'"), "window_end", 5)


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    return stored(x.daily_checkpoints(v.plays(s, d)), "checkpoints")


def export_checkpoints(s: SparkSession, d: str) -> DataFrame:
    return _checkpoints(s, d)


def last_exports(s: SparkSession, d: str) -> DataFrame:
    """The ten exports recorded last."""
    return m.latest(_checkpoints(s, d).select("version", "status", "session_tracks_rows", "exported_at"), "exported_at", 10)


def ended_exports(s: SparkSession, d: str) -> DataFrame:
    return _checkpoints(s, d).agg(F.count(F.when(F.col("status") == "success", 1)).alias("n_exports"), F.max("session_int_id_watermark").alias("watermark"))


def serving_model(s: SparkSession, d: str) -> DataFrame:
    """The model that is active now, and whether the last decision marks it as degraded, as 0 or 1."""
    active = _activations(s, d).where("status = 'active'").select(F.col("model_version").alias("active_version"), "activated_at")
    last = m.latest(_decisions(s, d).select("window_end", "decision"), "window_end")
    return active.crossJoin(last.select((F.col("decision") == "mark_degraded").cast("int").alias("degraded")))  # one row each


ROLLED = """, req AS (
  SELECT *, strftime(created_at, '%Y-%m') AS window_name, CASE WHEN metric_id % 4 > 0 THEN 'artist ' || (metric_id % 7) END AS artist, metric_id % 97 = 0 AS repeated FROM rm
), play AS (
  SELECT *, strftime(DATE '1992-01-01' + to_months((event_id % 80)::INT), '%Y-%m') AS window_name, event_type IN ('skip', 'complete') OR playratio IS NOT NULL AS fin FROM plays
), a AS (
  SELECT window_name, count(*) AS n, count(*) FILTER (pipeline_error) AS e, count(*) FILTER (fallback_state <> 'healthy') AS f,
    count(*) FILTER (fallback_state = 'catalog_insufficient') AS cat, count(*) FILTER (repeated) AS rep, avg(returned_count) AS ret, list_sort(list(total_latency_ms)) AS ls
  FROM req GROUP BY 1
), b AS (
  SELECT window_name, count(*) AS n_plays, count(*) FILTER (fin) AS n_fin, count(*) FILTER (fin AND event_type = 'skip') AS n_skip,
    count(*) FILTER (fin AND (event_type = 'complete' OR playratio >= 0.8)) AS n_complete, count(*) FILTER (track_id % 3 = 0) AS n_dislike FROM play GROUP BY 1
), artist AS (
  SELECT window_name, max(c) / sum(c) AS share FROM (SELECT window_name, artist, count(*) AS c FROM req WHERE artist IS NOT NULL GROUP BY 1, 2) GROUP BY 1
), model AS (
  SELECT window_name, model_version FROM (SELECT window_name, model_version, row_number() OVER (PARTITION BY window_name ORDER BY count(*) DESC, min((created_at, metric_id))) AS r
    FROM req GROUP BY 1, 2) WHERE r = 1
), rolled AS (
  SELECT window_name, ((window_name || '-01')::DATE + INTERVAL 1 MONTH)::TIMESTAMP AS window_end, n AS request_count, cat AS catalog_failure_count, rep AS repeat_violation_count,
    round(e / n, 6) AS error_rate, round(f / n, 6) AS fallback_rate, ret AS avg_returned_count, ls[round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT + 1] AS p50_latency_ms,
    ls[round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT + 1] AS p95_latency_ms, coalesce(round(share, 6), 0) AS top_artist_share, model_version,
    CASE WHEN n >= 20 THEN 'ok' ELSE 'insufficient' END AS sample_status, coalesce(n_fin, 0) AS finalized_playback_count, coalesce(n_plays, 0) AS feedback_count, 0 AS stream_failure_count,
    CASE WHEN n_fin > 0 THEN round(n_complete / n_fin, 6) ELSE 0 END AS completion_rate, CASE WHEN n_fin > 0 THEN round(n_skip / n_fin, 6) ELSE 0 END AS skip_rate,
    round(coalesce(n_dislike, 0) / greatest(n, 1), 6) AS dislike_rate, 0.0 AS stream_failure_rate
  FROM a LEFT JOIN b USING (window_name) LEFT JOIN artist USING (window_name) LEFT JOIN model USING (window_name)
)"""

DECIDED = ROLLED + f""", act AS (
  SELECT model_version, min(created_at + to_seconds(metric_id % 50)) AS activated_at FROM rm GROUP BY model_version, year(created_at)
), span AS (
  SELECT *, lead(activated_at) OVER (ORDER BY activated_at, model_version) AS deactivated_at, lag(model_version) OVER (ORDER BY activated_at, model_version) AS before FROM act
), served AS (
  SELECT rolled.*, span.model_version AS active_version, CASE WHEN span.before <> span.model_version THEN span.before END AS previous_version
  FROM rolled LEFT JOIN span ON activated_at <= window_end AND (deactivated_at IS NULL OR window_end < deactivated_at)
), ruled AS (
  SELECT *, CASE WHEN request_count < 20 THEN 'insufficient_sample' WHEN error_rate > {LIMITS["max_error_rate"]} THEN 'high_error_rate'
    WHEN fallback_rate > {LIMITS["max_fallback_rate"]} THEN 'high_fallback_rate' WHEN p95_latency_ms > {LIMITS["max_p95_latency_ms"]} THEN 'latency_breach'
    WHEN stream_failure_rate > 0.05 THEN 'stream_failure_rate' WHEN dislike_rate > {LIMITS["max_dislike_rate"]} THEN 'high_dislike_rate'
    WHEN repeat_violation_count > 0 THEN 'repeat_violation' WHEN top_artist_share > {LIMITS["max_top_artist_share"]} THEN 'top_artist_concentration' ELSE 'within_thresholds' END AS rule
  FROM served
), decided AS (
  SELECT window_name, window_end, CASE WHEN rule IN ('insufficient_sample', 'within_thresholds') THEN 'no_action'
      WHEN rule IN ('high_error_rate', 'high_fallback_rate', 'high_dislike_rate') AND previous_version IS NOT NULL THEN 'recommend_rollback' ELSE 'mark_degraded' END AS decision,
    CASE WHEN rule IN ('high_error_rate', 'high_fallback_rate', 'high_dislike_rate') AND previous_version IS NULL THEN rule || '_no_previous_good' ELSE rule END AS reason,
    active_version, previous_version
  FROM ruled
)"""


CHECKPOINTS = """, days AS (
  SELECT date_trunc('day', created_at)::TIMESTAMP AS day, count(playratio) AS n, max(session_int_id) FILTER (playratio IS NOT NULL) AS top FROM plays GROUP BY 1
), checkpoint AS (
  SELECT strftime(day, '%Y%m%d') AS version, CASE WHEN n > 0 THEN 'success' ELSE 'skipped' END AS status, n AS session_tracks_rows,
    max(top) OVER (ORDER BY day) AS session_int_id_watermark, day + INTERVAL 1 DAY AS exported_at FROM days
)"""


def _sql(chain: str, body: str) -> str:
    return sql("rm plays", "").rstrip() + chain + "\n" + body


QUERIES = {
    "monthly_rollups": (monthly_rollups, _sql(ROLLED, "SELECT * FROM rolled")),
    "rollup_decisions": (rollup_decisions, _sql(DECIDED, "SELECT * FROM decided")),
    "outcome_series": (outcome_series, _sql(ROLLED, "SELECT window_end, completion_rate, skip_rate, dislike_rate, fallback_rate, error_rate, p95_latency_ms FROM rolled")),
    "last_rollups": (
        last_rollups,
        _sql(ROLLED, "SELECT window_name, window_end, request_count, fallback_rate, error_rate, sample_status FROM rolled ORDER BY window_end DESC LIMIT 5"),
    ),
    "export_checkpoints": (export_checkpoints, _sql(CHECKPOINTS, "SELECT * FROM checkpoint")),
    "last_exports": (last_exports, _sql(CHECKPOINTS, "SELECT version, status, session_tracks_rows, exported_at FROM checkpoint ORDER BY exported_at DESC LIMIT 10")),
    "ended_exports": (ended_exports, _sql(CHECKPOINTS, "SELECT count(*) FILTER (status = 'success') AS n_exports, max(session_int_id_watermark) AS watermark FROM checkpoint")),
    "serving_model": (
        serving_model,
        _sql(
            DECIDED,
            """SELECT model_version AS active_version, activated_at, (SELECT (decision = 'mark_degraded')::INT FROM decided ORDER BY window_end DESC LIMIT 1) AS degraded
              FROM span WHERE deactivated_at IS NULL""",
        ),
    ),
    "last_rollbacks": (last_rollbacks, _sql(DECIDED, "SELECT * FROM decided WHERE decision <> 'no_action' ORDER BY window_end DESC LIMIT 5")),
}
