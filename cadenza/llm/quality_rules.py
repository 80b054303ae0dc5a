"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured in its own row (no shuffle of words). The failures of each rule are then counted
by host, the rates are shrunk towards the mean of all hosts with a beta prior fitted to the hosts by moments,
and hosts whose shrunk rate of any rule is over `max_rate` are rejected; the verdict is joined back.

Defined cases: a null text has no words (and fails the word minimum); a null host is no host, its documents
are judged by their own rules only; repeated rows are counted and returned as often as they occur; an empty
table gives an empty result. Other columns of the input pass through `judge`; a measure replaces an input
column of the same name, and columns named as a rule's flag (`fails_...`) are left out. `keep_good` returns all
columns as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import broadcast_if_small, materialize

SPACE = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("fails_base", "fails_symbols", "fails_lines", "fails_length")
#: Up to so many repeated hashes, positions are found by looking each hash up; beyond, by a sort of (hash, position).
FEW = 48


def _covered(starts: Column, size: int) -> Column:
    """Number of positions in windows of `size` that begin at the ascending `starts`."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-size).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(size), i - acc["last"])).cast("bigint").alias("n"), i.cast("int").alias("last")
        ),
    )
    return step["n"]


def measure(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """`docs` with the five counts of MEASURES (long) and `_n_lines` for the whole text of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))
    plain = whole
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, window)]))
    hashes = F.slice(hashes, 1, F.greatest(F.size("_words") - (window - 1), F.lit(0)))
    again = F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get("_sorted", i - 1)))
    looked_up = F.filter(
        F.transform("_hashes", lambda h, i: F.when(F.array_contains("_again", h), i)), lambda i: i.isNotNull()
    )
    ordered = F.filter("_pairs", lambda x, k: (F.get("_pairs", k - 1)["h"] == x["h"]) | (F.get("_pairs", k + 1)["h"] == x["h"]))
    pairs = F.when(
        F.size("_again") > FEW, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    starts = (
        F.when(F.size("_again") == 0, F.array().cast("array<int>"))
        .when(F.size("_again") <= FEW, looked_up)
        .otherwise(F.array_sort(F.transform(ordered, lambda x: x["i"])))
    )
    return (
        docs.withColumns({"_words": words, "_lines": lines})
        .withColumn("_hashes", hashes)
        .withColumn("_sorted", F.sort_array("_hashes"))
        .withColumn("_again", again)
        .withColumn("_pairs", pairs)
        .withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
                "n_symbols": (F.length(whole) - F.length(plain)).cast("bigint"),
                "_n_lines": F.size("_lines"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
                "n_repeat_words": _covered(starts, window),
            }
        )
        .drop("_words", "_lines", "_hashes", "_sorted", "_again", "_pairs")
    )


def flags(
    min_words: int = 50,
    max_repeat: float = 0.5,
    max_symbols: float = 0.3,
    max_dup_lines: float = 0.5,
    mean_length: tuple[float, float] = (2.0, 15.0),
) -> dict[str, Column]:
    """The document rules over MEASURES and `_n_lines`. `fails_base` alone rejects a document; the others count for its host."""
    n, length = F.col("n_words"), F.col("word_chars")
    return {
        "fails_base": (n < min_words) | (100 * F.col("n_repeat_words") > F.lit(100 * max_repeat) * n),
        "fails_symbols": F.col("n_symbols") > F.lit(max_symbols) * length,
        "fails_lines": F.col("n_dup_lines") > F.lit(max_dup_lines) * F.col("_n_lines"),
        "fails_length": (length < F.lit(mean_length[0]) * n) | (length > F.lit(mean_length[1]) * n),
    }


def host_verdicts(judged: DataFrame, host: str, max_rate: float = 0.5, prior_limit: float = 1e6) -> DataFrame:
    """(host, n_docs, rate_<rule> ..., host_rejected): failure rates shrunk by a beta prior, one row per non-null host."""
    counts = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("_host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("bigint")).alias(r) for r in RULES])
    )
    moments = []
    for r in RULES:
        moments += [
            (F.sum(r) / F.sum("n_docs")).alias(f"m_{r}"),
            F.coalesce(F.var_pop(F.col(r) / F.col("n_docs")), F.lit(0.0)).alias(f"v_{r}"),
        ]
    prior = counts.agg(*moments)
    rated = counts.crossJoin(F.broadcast(prior))  # one row of moments
    rates = {}
    for r in RULES:
        mean, spread = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(
            spread > 0, F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(prior_limit))
        ).otherwise(F.lit(prior_limit))
        rates[f"rate_{r[6:]}"] = (F.col(r) + mean * strength) / (F.col("n_docs") + strength)
    rejected = F.greatest(*[F.col(c) for c in rates]) > max_rate
    return rated.withColumns(rates).select("_host", "n_docs", *rates, rejected.alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5, **rules: float) -> DataFrame:
    """`docs` without `text`, with MEASURES, `base_failed`, `host_rejected` and `kept` (booleans)."""
    measured = measure(docs, text).drop(text).withColumns(flags(**rules))
    measured = materialize(measured, "quality")
    bad = host_verdicts(measured, host, max_rate).where("host_rejected").select("_host", "host_rejected")
    bad = broadcast_if_small(bad)
    joined = measured.join(bad, measured[host] == bad["_host"], "left").drop("_host")
    return (
        joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("base_failed", F.col("fails_base"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop(*RULES, "_n_lines")
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5, **rules: float) -> DataFrame:
    """The rows of `docs` that pass their own rules and whose host is not rejected, with the same columns."""
    clashing = {c: f"_input_{c}" for c in docs.columns if c.lower() in {*MEASURES, *RULES} and c not in (host, text)}
    measured = measure(docs.withColumnsRenamed(clashing), text).withColumns(flags(**rules))
    measured = materialize(measured, "quality-rows")
    bad = host_verdicts(measured, host, max_rate).where("host_rejected").select("_host")
    bad = broadcast_if_small(bad)
    passed = measured.where(~F.col("fails_base"))
    kept = passed.join(bad, passed[host] == bad["_host"], "left_anti")
    return kept.select(*[F.col(clashing.get(c, c)).alias(c) for c in docs.columns])
