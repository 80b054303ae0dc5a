"""Windowed serving metrics, decision rules and dashboard queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import ratio
from cadenza.sources.shared import stored


def in_window(rows: DataFrame, start: str, end: str, column: str = "created_at") -> DataFrame:
    """Rows from start to end, both included; rows without a time stay."""
    when = F.col(column)
    return rows.where(when.isNull() | when.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


#: Groups up to which their bounds go to all tasks; beyond it rows and bounds meet by a shuffle.
FEW_GROUPS = 50_000


def values_at(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], key: list[str], passes: int = 3, buckets: int = 1024) -> DataFrame:
    """(key…, one column per place): the values at these places, from 0, of each group's sorted values; nulls are left out.

    `places` are given the group's number of values. A pass counts the values between the bounds in `buckets` parts of
    equal width and takes the least and greatest value of the part that holds the place as new bounds. Each pass is an aggregate with partial results in every
    task; what is left after the passes, one value or a few close ones, is sorted. No group's values come together.
    """
    x = F.col(value).cast("double")
    narrow = rows.where(x.isNotNull()).select(*key, x.alias("_x")).withColumn("_all", F.lit(1))
    key = [*key, "_all"]
    ends = stored(narrow.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), "ends")
    few = ends.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("bigint").alias("k")) for name, place in places.items()]))
    state = ends.select(*key, "_lo", "_hi", wanted.alias("w")).select(*key, "_lo", "_hi", F.col("w.name").alias("_name"), F.col("w.k").alias("_k"))
    group = [*key, "_name"]
    inside = lambda: narrow.join(F.broadcast(state) if few else state, key).where("_x BETWEEN _lo AND _hi")
    for _ in range(passes):
        width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        part = F.least(F.coalesce(F.floor((F.col("_x") - F.col("_lo")) / width * buckets), F.lit(0)), F.lit(buckets - 1))
        counts = inside().groupBy(*group, "_k", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_part"))
        found = counts.withColumn("_upto", upto).where("_upto > _k AND _upto - _c <= _k")
        state = found.select(*group, "_lo", "_hi", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"))
    counts = inside().groupBy(*group, "_k", "_x").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group).orderBy("_x"))).where("_upto > _k AND _upto - _c <= _k")
    return counts.groupBy(*key).agg(*[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in places]).drop("_all")


def nearest_rank(rows: DataFrame, value: str, percents: dict[str, int], key: list[str]) -> DataFrame:
    """(key…, one column per percentile): the value at half-even(p / 100 * (n - 1)) of each group's sorted values."""
    return values_at(rows, value, {name: lambda n, p=p: F.bround(F.lit(p / 100.0) * (n - 1)) for name, p in percents.items()}, key)


def median(rows: DataFrame, value: str, key: list[str], name: str) -> DataFrame:
    """(key…, name): the middle value of each group, between two middle ones their mean."""
    both = values_at(rows, value, {"_below": lambda n: F.floor((n - 1) / 2), "_above": lambda n: F.ceil((n - 1) / 2)}, key)
    return both.select(*key, ((F.col("_below") + F.col("_above")) / 2).alias(name))


def first_mode(rows: DataFrame, value: str, order: list[str], key: list[str]) -> DataFrame:
    """(key…, value, share): the most frequent value, of equally frequent ones the one met first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*order)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "first"))
    total = F.sum("c").over(Window.partitionBy(*key))
    return counts.select(*key, value, ratio(F.col("c"), total).alias("share"), rank.alias("_r")).where("_r = 1").drop("_r")


def _filled(column: str, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(otherwise))


def request_rollup(requests: DataFrame, key: list[str], least: int = 20) -> DataFrame:
    """Rates, latencies and counts of requests by group.

    A request failed if its pipeline did or it has an error code, and fell back if its level is not none or its state not
    healthy; null and empty ones are none and healthy. `error_code` and `fallback_level` need not be there.
    """
    error, fallback = F.coalesce("pipeline_error", F.lit(False)), _filled("fallback_state", "healthy") != "healthy"
    if "error_code" in requests.columns:
        error |= _filled("error_code", "") != ""
    if "fallback_level" in requests.columns:
        fallback |= _filled("fallback_level", "none") != "none"
    n = F.col("request_count")
    sums = requests.groupBy(*key).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count(F.when(error, 1)).alias("_e"),
        F.count(F.when(fallback, 1)).alias("_f"),
        F.count(F.when(F.col("fallback_state") == "catalog_insufficient", 1)).alias("catalog_failure_count"),
        F.coalesce(F.avg(F.coalesce("returned_count", F.lit(0))), F.lit(0.0)).alias("avg_returned_count"),
    )
    latency = requests.withColumn("latency", F.coalesce("total_latency_ms", F.lit(0.0)))
    latency = nearest_rank(latency, "latency", {"p50_latency_ms": 50, "p95_latency_ms": 95}, key)
    return sums.join(latency, key).select(
        *key,
        "request_count",
        ratio(F.col("_e"), n).alias("error_rate"),
        ratio(F.col("_f"), n).alias("fallback_rate"),
        "catalog_failure_count",
        "avg_returned_count",
        "p50_latency_ms",
        "p95_latency_ms",
        F.when(n >= least, "ok").otherwise("insufficient").alias("sample_status"),
    )


def joint_rollups(requests: DataFrame, plays: DataFrame, feedback: DataFrame, windows: DataFrame, least: int = 20) -> DataFrame:
    """One row for each of `windows` (window_name, …) over requests (with artist and track_ids), plays and feedback.

    All have the window_name that they fall in. A window without rows has zeros.
    """
    artists = first_mode(requests.where("artist <> ''"), "artist", ["created_at", "metric_id"], ["window_name"])
    models = first_mode(requests.where("model_version <> ''"), "model_version", ["created_at", "metric_id"], ["window_name"])
    repeats = requests.groupBy("window_name").agg(
        F.count(F.when(F.size("track_ids") > F.size(F.array_distinct("track_ids")), 1)).alias("repeat_violation_count")
    )
    finalized = F.coalesce(F.col("event_type").isin("skip", "complete"), F.lit(False)) | F.col("playratio").isNotNull()
    complete = (F.col("event_type") == "complete") | (F.col("playratio") >= 0.8)
    played = plays.groupBy("window_name").agg(
        F.count(F.when(finalized, 1)).alias("finalized_playback_count"),
        F.count(F.when(finalized & (F.col("event_type") == "skip"), 1)).alias("_skips"),
        F.count(F.when(finalized & complete, 1)).alias("_completes"),
        F.count(F.when(F.startswith("event_type", F.lit("stream_failure")), 1)).alias("stream_failure_count"),
        F.count(F.lit(1)).alias("_plays"),
    )
    said = feedback.groupBy("window_name").agg(F.count(F.lit(1)).alias("feedback_count"), F.count(F.when(F.col("feedback_type") == "dislike", 1)).alias("_dislikes"))
    rows = windows
    for part in (played, said, request_rollup(requests, ["window_name"], least), repeats, models.select("window_name", "model_version")):
        rows = rows.join(part, "window_name", "left")
    rows = rows.join(artists.select("window_name", F.col("share").alias("top_artist_share")), "window_name", "left")
    counts = ("request_count", "catalog_failure_count", "repeat_violation_count")
    rates = ("error_rate", "fallback_rate", "avg_returned_count", "p50_latency_ms", "p95_latency_ms", "top_artist_share")
    others = ("finalized_playback_count", "_skips", "_completes", "stream_failure_count", "_plays", "feedback_count", "_dislikes")
    rows = rows.fillna(0, [*counts, *others]).fillna(0.0, list(rates)).fillna("insufficient", ["sample_status"])
    shares = {
        "completion_rate": ratio(F.col("_completes"), F.col("finalized_playback_count")),
        "skip_rate": ratio(F.col("_skips"), F.col("finalized_playback_count")),
        "dislike_rate": ratio(F.col("_dislikes"), F.greatest("request_count", F.lit(1))),
        "stream_failure_rate": ratio(F.col("stream_failure_count"), F.greatest("_plays", F.lit(1))),
    }
    extra = ("model_version", "sample_status", "finalized_playback_count", "feedback_count", "stream_failure_count")
    return rows.withColumns(shares).select(*windows.columns, *counts, *rates, *extra, *shares)


def joint_rollup(requests: DataFrame, plays: DataFrame, feedback: DataFrame, name: str, start: str, end: str, least: int = 20) -> DataFrame:
    """One row for a window over requests (with artist and track_ids), plays and feedback; no rows in it give zeros."""
    named = [in_window(rows, start, end).withColumn("window_name", F.lit(name)) for rows in (requests, plays, feedback)]
    return joint_rollups(*named, requests.sparkSession.range(1).select(F.lit(name).alias("window_name")), least)


def window_length(text: str) -> str:
    """The interval of a window like 5m, 1h or 1d, for SQL; anything else is an error."""
    units = {"m": "MINUTES", "h": "HOURS", "d": "DAYS"}
    amount, unit = text.strip()[:-1], text.strip()[-1:].lower()
    if unit not in units or not re.fullmatch(r"[+-]?\d+", amount):
        raise ValueError(f"window {text!r} must be a number and m, h or d")
    return f"{int(amount)} {units[unit]}"


def parsed_time(text: Column) -> Column:
    """The UTC time of an ISO text with Z, an offset or none (which is UTC); null if it is not one."""
    plain = F.regexp_replace(text, r"[Zz]\z", "+00:00")
    zoned = F.when(plain.rlike(r"[+-]\d\d:?\d\d\z"), plain).otherwise(F.concat(plain, F.lit("+00:00")))
    return F.try_to_timestamp(zoned)


def serving_models(rollups: DataFrame, activations: DataFrame, at: str) -> DataFrame:
    """`rollups` with active_version and previous_version: the model activated last until the time `at`, and the one before it.

    One activation replaces the other, so the two are found among the (few) activations as of each window: each activation
    holds from its time to the next one's.
    """
    span = activations.select("model_version", "parent", "activated_at", "deactivated_at")
    holds = (F.col("activated_at") <= F.col(at)) & (F.col("deactivated_at").isNull() | (F.col(at) < F.col("deactivated_at")))
    named = span.select("activated_at", "deactivated_at", F.col("model_version").alias("active_version"), F.col("parent").alias("previous_version"))
    return rollups.join(named, holds, "left").drop("activated_at", "deactivated_at")


def playback_rollup(plays: DataFrame, key: list[str]) -> DataFrame:
    """Completion and skip rates of finalized plays and the share of stream failures by group."""
    kind, share = F.col("event_type"), F.coalesce("playratio", F.lit(0.0))
    final = kind.isin("skip", "complete") | F.col("playratio").isNotNull()
    sums = plays.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(final, 1)).alias("finalized_count"),
        F.count(F.when(final & (kind == "skip"), 1)).alias("_s"),
        F.count(F.when(final & ((kind == "complete") | (share >= 0.8)), 1)).alias("_c"),
        F.count(F.when(F.coalesce(kind, F.lit("")).startswith("stream_failure"), 1)).alias("_x"),
    )
    return sums.select(
        *key,
        "n_events",
        "finalized_count",
        ratio(F.col("_c"), F.col("finalized_count")).alias("completion_rate"),
        ratio(F.col("_s"), F.col("finalized_count")).alias("skip_rate"),
        ratio(F.col("_x"), F.greatest("n_events", F.lit(1))).alias("stream_failure_rate"),
    )


def repeated_lists(rows: DataFrame, column: str) -> DataFrame:
    """Number of rows whose list (or comma-separated string) holds an element twice."""
    items = F.col(column) if dict(rows.dtypes)[column].startswith("array") else F.filter(F.split(column, ","), lambda x: x != "")
    return rows.agg(F.count(F.when(F.size(items) != F.size(F.array_distinct(items)), 1)).alias("repeat_violation_count"))


#: (condition, decision, reason), the first that holds counts.
ROLLBACK_LIMITS = {"minimum_request_count": 20, "max_error_rate": 0.05, "max_fallback_rate": 0.25, "max_p95_latency_ms": 1500.0, "max_stream_failure_rate": 0.05, "max_dislike_rate": 0.15, "max_top_artist_share": 0.60}


def _first_rule(rules: list[tuple[Column, str, str]], names: tuple[str, str], otherwise: tuple[str, str]) -> Column:
    out = F.struct(F.lit(otherwise[0]).alias(names[0]), F.lit(otherwise[1]).alias(names[1]))
    for condition, a, b in reversed(rules):
        out = F.when(condition, F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]))).otherwise(out)
    return out


def rollback_decision(rollups: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """`rollups` with decision and reason. Absent measures count as 0; `previous_version` null or '': no earlier model."""
    at = ROLLBACK_LIMITS | (limits or {})

    def value(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rollups.columns else F.lit(0.0)

    rules = [
        (value("request_count") < at["minimum_request_count"], "no_action", "insufficient_sample"),
        (value("error_rate") > at["max_error_rate"], "recommend_rollback", "high_error_rate"),
        (value("fallback_rate") > at["max_fallback_rate"], "recommend_rollback", "high_fallback_rate"),
        (value("p95_latency_ms") > at["max_p95_latency_ms"], "mark_degraded", "latency_breach"),
        (value("stream_failure_rate") > at["max_stream_failure_rate"], "mark_degraded", "stream_failure_rate"),
        (value("dislike_rate") > at["max_dislike_rate"], "recommend_rollback", "high_dislike_rate"),
        (value("repeat_violation_count") > 0, "mark_degraded", "repeat_violation"),
        (value("top_artist_share") > at["max_top_artist_share"], "mark_degraded", "top_artist_concentration"),
    ]
    out = rollups.withColumn("_d", _first_rule(rules, ("decision", "reason"), ("no_action", "within_thresholds")))
    none = F.nullif(F.col("previous_version"), F.lit("")).isNull() if "previous_version" in rollups.columns else F.lit(True)
    lonely = (F.col("_d.decision") == "recommend_rollback") & none
    return out.withColumns(
        {
            "decision": F.when(lonely, "mark_degraded").otherwise(F.col("_d.decision")),
            "reason": F.when(lonely, F.concat(F.col("_d.reason"), F.lit("_no_previous_good"))).otherwise(F.col("_d.reason")),
        }
    ).drop("_d")


def serving_state(requests: DataFrame, least: int = 4) -> DataFrame:
    """`requests` with state, fallback_level and reason.

    Columns: playable_count, ranked_count, returned_count, bundle_available, pipeline_error, degraded, action, status_reason.
    """
    playable, returned = F.col("playable_count"), F.col("returned_count")
    degraded = F.coalesce("degraded", F.lit(False))
    only = degraded & (F.lower(F.trim("action")) == "fallback_only")
    rules = [
        ((playable < least) | (returned < F.least(F.lit(least), playable)), "catalog_insufficient", "catalog_safe_fallback"),
        (~F.col("bundle_available"), "model_unavailable", "non_personalized"),
        (F.coalesce("pipeline_error", F.lit(False)), "model_unavailable", "catalog_safe_fallback"),
        (only, "fallback_only", "catalog_safe_fallback"),
        (degraded, "model_degraded", "non_personalized"),
        ((returned == 0) | (F.col("ranked_count") == 0), "fallback_only", "catalog_safe_fallback"),
    ]
    reasons = [F.lit("catalog_insufficient"), F.lit("model_unavailable"), F.lit("pipeline_error")]
    given = F.coalesce(F.nullif(F.col("status_reason"), F.lit("")), F.lit("manual_degraded"))
    reasons += [given, given, F.lit("empty_ranked_output")]
    reason = F.lit(None).cast("string")
    for (condition, _, _), text in reversed(list(zip(rules, reasons, strict=True))):
        reason = F.when(condition, text).otherwise(reason)
    out = requests.withColumn("_s", _first_rule(rules, ("state", "fallback_level"), ("healthy", "none"))).withColumn("reason", reason)
    return out.withColumns({"state": F.col("_s.state"), "fallback_level": F.col("_s.fallback_level")}).drop("_s")


def promotion_decision(candidates: DataFrame, min_recall: float = 0.0, min_mrr: float = 0.0, max_recall_drop: float = 0.02, max_mrr_drop: float = 0.02) -> DataFrame:
    """`candidates` (recall, mrr, baseline_recall, baseline_mrr) with decision (approve or block) and reason."""
    recall, mrr, base_recall, base_mrr = (F.coalesce(c, F.lit(0.0)) for c in ("recall", "mrr", "baseline_recall", "baseline_mrr"))
    rules = [
        (recall < min_recall, "block", "recall_below_minimum"),
        (mrr < min_mrr, "block", "mrr_below_minimum"),
        (base_recall - recall > max_recall_drop, "block", "recall_regression"),
        (base_mrr - mrr > max_mrr_drop, "block", "mrr_regression"),
    ]
    return candidates.withColumn("_d", _first_rule(rules, ("decision", "reason"), ("approve", "offline_metrics_passed"))).select("*", "_d.*").drop("_d")


def activation_gate(decisions: DataFrame, override: Column) -> DataFrame:
    """`decisions` (decision, decided_version, model_version) with `activated` and why not."""
    approved = F.lower(F.coalesce("decision", F.lit(""))).isin("approve", "approved")
    same = F.coalesce(F.nullif(F.col("decided_version"), F.lit("")), F.col("model_version")) == F.col("model_version")
    rules = [(~approved & override, "true", "override"), (~approved, "false", "not_approved"), (~same, "false", "version_mismatch")]
    out = decisions.withColumn("_g", _first_rule(rules, ("activated", "gate"), ("true", "approved")))
    return out.withColumn("activated", F.col("_g.activated") == "true").withColumn("gate", F.col("_g.gate")).drop("_g")


def session_status(queues: DataFrame) -> DataFrame:
    """`queues` (fallback_level, degraded, action, status_reason) with fallback_state and degraded_reason."""
    degraded = F.coalesce("degraded", F.lit(False))
    given = F.coalesce(F.nullif(F.col("status_reason"), F.lit("")), F.lit("manual_degraded"))
    state = F.when(degraded & (F.col("action") == "fallback_only"), "fallback_only").when(degraded, "model_degraded")
    state = state.when(F.col("fallback_level") != "none", "fallback_only").otherwise("healthy")
    reason = F.when(degraded, given).when(F.col("fallback_level") != "none", "session_fallback_queue")
    return queues.withColumns({"fallback_state": state, "degraded_reason": reason})


def latency_summary(requests: DataFrame) -> DataFrame:
    """Latency and rates by endpoint and for all: interpolating median, nearest-rank p95 and p99, mean, extremes."""
    rows = requests.withColumn("latency", F.col("total_latency_ms"))
    both = rows.unionByName(rows.withColumn("endpoint", F.lit("combined")))
    sums = both.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("latency").alias("avg"),
        F.min("latency").alias("least"),
        F.max("latency").alias("most"),
        F.round(F.avg(F.when(F.col("pipeline_error"), 1.0).otherwise(0.0)), 4).alias("error_rate"),
        F.round(F.avg(F.when(F.col("fallback_state") != "healthy", 1.0).otherwise(0.0)), 4).alias("fallback_rate"),
    )
    middle = median(both, "latency", ["endpoint"], "p50")
    return sums.join(middle, "endpoint").join(nearest_rank(both, "latency", {"p95": 95, "p99": 99}, ["endpoint"]), "endpoint")


def hourly(rows: DataFrame, *measures: Column, column: str = "created_at") -> DataFrame:
    return rows.groupBy(F.date_trunc("hour", column).cast("timestamp_ntz").alias("hour")).agg(*measures)


def latest(rows: DataFrame, column: str, n: int = 1, tie: str | None = None) -> DataFrame:
    """The n last rows by a column, nulls last."""
    return rows.orderBy(F.desc_nulls_last(column), *([tie] if tie else [])).limit(n)


def trailing_windows(rows: DataFrame, now: str, lengths: dict[str, str], column: str = "created_at") -> DataFrame:
    """Each row once for every trailing window (window_name) that it lies in; windows end at `now`, both ends included."""
    end = F.lit(now).cast("timestamp_ntz")
    names = F.array_compact(F.array(*[F.when(F.col(column) >= end - F.expr(f"INTERVAL {length}"), F.lit(name)) for name, length in lengths.items()]))
    return rows.where(F.col(column) <= end).withColumn("window_name", F.explode(names))
