"""Training contexts, negatives, losses and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import label_code, label_target, unit_of
from cadenza.operators.features import top_neighbours
from cadenza.sources.shared import stored

LENGTH = 20


def prefixes(tracks: DataFrame, length: int = LENGTH) -> DataFrame:
    """The tracks and label codes of the last `length` plays up to each one, filled up with 0 and 3 on the left."""
    frame = Window.partitionBy("session_id").orderBy("position").rowsBetween(-(length - 1), 0)
    rows = tracks.withColumns({"_t": F.collect_list("track_id").over(frame), "_l": F.collect_list(label_code(F.col("label"))).over(frame)})
    fill = lambda value, column: F.concat(F.array_repeat(F.lit(value), F.lit(length) - F.size(column)), column)
    return rows.select(
        "session_id", "user_id", "position", fill(0, F.col("_t")).alias("prefix"), fill(3, F.col("_l")).alias("prefix_labels"), F.size("_t").alias("prefix_len")
    )


def contexts(tracks: DataFrame, validation: bool = False) -> DataFrame:
    """(session_id, user_id, t, last, anchor, y, weight): the last track of each prefix and what follows it.

    Training: t = 0 .. n - 3 with the play after it as anchor, in sessions of 3 or more. Validation: the last play only,
    in sessions of 2 or more. Anchors with an unknown label are left out.
    """
    session = Window.partitionBy("session_id")
    order = session.orderBy("position")
    rows = tracks.select(
        "session_id",
        "user_id",
        (F.row_number().over(order) - 1).alias("t"),
        F.col("track_id").alias("last"),
        F.lead("track_id").over(order).alias("anchor"),
        F.lead("label").over(order).alias("anchor_label"),
        F.count(F.lit(1)).over(session).alias("n"),
    )
    chosen = (F.col("n") >= 2) & (F.col("t") == F.col("n") - 2) if validation else (F.col("n") >= 3) & (F.col("t") <= F.col("n") - 3)
    y, weight = label_target(F.col("anchor_label"))
    return rows.where(chosen & (F.col("anchor_label") != "unknown")).select("session_id", "user_id", "t", "last", "anchor", y.alias("y"), weight.alias("weight"))


def with_hard_negatives(found: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """`found` with `hard`, the k heaviest neighbours of the prefix's last track in their order, without the anchor; null if the track has no neighbour."""
    near = top_neighbours(edges, k + 1, loops=True)  # of these the anchor is one at most
    near = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("near"))
    rows = found.join(near, found["last"] == near["src"], "left")
    left = F.slice(F.filter("near", lambda x: x["dst"] != F.col("anchor")), 1, k)
    return rows.select(*found.columns, F.transform(left, lambda x: x["dst"]).alias("hard"))


def hard_negatives(found: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(session_id, t, candidate, rank): the k heaviest neighbours of the prefix's last track, without the anchor."""
    rows = with_hard_negatives(found, edges, k).select("session_id", "t", F.posexplode("hard").alias("rank", "candidate"))
    return rows.select("session_id", "t", "candidate", (F.col("rank") + 1).alias("rank"))


def _spans(weights: DataFrame, bands: int, width: int = 4096) -> DataFrame:
    """(candidate, from, to, band): the weights laid out on [0, total) by track, once for every band that they touch.

    Running sums are made in ranges of `width` track numbers, and begin at the sum of the ranges before. They are sums of decimals
    of 27 places, so a place is exact to its last binary digit, and the same however the rows are dealt.
    """
    kind = "decimal(38, 27)"
    ranged = weights.withColumn("range", F.floor(F.col("track_id") / width)).withColumn("w", F.col("weight").cast(kind))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("range").agg(F.sum("w").cast(kind).alias("s")).select("range", F.coalesce(F.sum("s").over(before).cast(kind), F.lit(0).cast(kind)).alias("base"))
    spans = ranged.withColumn("sum", F.sum("w").over(Window.partitionBy("range").orderBy("track_id")).cast(kind)).join(base, "range")
    to = (F.col("base") + F.col("sum")).cast(kind)
    spans = spans.withColumn("to", to.cast("double")).withColumn("from", (to - F.col("w")).cast("double"))
    touched = F.sequence(F.floor(F.col("from") * bands), F.floor(F.col("to") * bands))
    return spans.select(F.col("track_id").alias("candidate"), "from", "to", F.explode(touched).alias("band"))


def random_negatives(found: DataFrame, weights: DataFrame, hard: DataFrame | None = None, n: int = 5, tries: int = 12, most: int = 200) -> DataFrame:
    """(session_id, t, candidate, rank): tracks drawn with the given weights that make up n with the context's `hard` ones.

    They differ, and the anchor and the hard ones are left out. A draw is a number in [0, total) from a hash of the
    context and the try. The weights are laid out on [0, total) in bands, so a draw is an equi-join on its band and a
    comparison, never a comparison with all tracks. Contexts that are short after `tries` draws get up to `most` for every
    track they need, and then the first tracks of the vocabulary: as many as it has.
    """
    key, bands = ["session_id", "t"], 4096
    spans = stored(_spans(weights, bands), "spans")
    none = F.array().cast("array<bigint>")
    rows = found.select(*key, "anchor").withColumn("gone", none)
    if hard is not None:
        rows = rows.drop("gone").join(hard.groupBy(*key).agg(F.collect_set(F.col("candidate").cast("bigint")).alias("gone")), key, "left")
    rows = rows.withColumn("gone", F.array_except(F.coalesce("gone", none), F.array(F.col("anchor").cast("bigint"))))
    rows = rows.withColumn("need", n - F.size("gone")).where("need > 0")
    rows = rows.select(*key, "need", F.concat("gone", F.array(F.col("anchor").cast("bigint"))).alias("gone"), none.alias("got"))

    def with_more(rows: DataFrame, more: str) -> DataFrame:
        fresh = F.array_except(F.array_except(more, "gone"), F.col("got"))
        return rows.withColumn("got", F.concat("got", F.slice(fresh, F.lit(1), F.col("need") - F.size("got")))).drop(more)

    # most contexts are full after one draw more than they need, so only the others draw on
    soon = F.least(F.lit(tries), F.col("need") + 1)
    for first, last in ((F.lit(1), soon), (soon + 1, F.lit(tries)), (F.lit(tries + 1), most * F.col("need"))):
        drawn = rows.where((F.size("got") < F.col("need")) & (last >= first)).select(*key, F.explode(F.sequence(first, last)).alias("try"))
        drawn = drawn.withColumn("u", unit_of(F.concat_ws(":", "session_id", "t", "try"))).withColumn("band", F.floor(F.col("u") * bands))
        met = drawn.join(spans, "band").where("u >= `from` AND u < `to`").select(*key, "try", F.col("candidate").cast("bigint").alias("c"))
        hits = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("try", "c"))).alias("hits"))
        rows = stored(with_more(rows.join(hits, key, "left").withColumn("more", F.array_distinct(F.coalesce(F.col("hits.c"), none))).drop("hits"), "more"), "drawn")
    # a context leaves out n tracks at most besides those it has, and needs n at most
    head = weights.select(F.col("track_id").cast("bigint").alias("track_id")).orderBy("track_id").limit(3 * n + 1)
    head = head.agg(F.sort_array(F.collect_list("track_id")).alias("head"))
    rows = with_more(rows.crossJoin(F.broadcast(head)), "head")
    kind = weights.schema["track_id"].dataType
    out = rows.select(*key, F.posexplode("got").alias("rank", "candidate"))
    return out.select(*key, F.col("candidate").cast(kind).alias("candidate"), (F.col("rank") + 1).alias("rank"))


def ranking_metrics(scored: DataFrame, k: int = 5) -> DataFrame:
    """hr, ndcg and mrr at k of (context, score, is_positive); equal scores favour the positive one."""
    positive = F.max(F.when(F.col("is_positive"), F.col("score"))).over(Window.partitionBy("context"))
    ranks = scored.withColumn("_p", positive).groupBy("context").agg((F.sum(F.when(F.col("score") > F.col("_p"), 1).otherwise(0)) + 1).alias("rank"))
    hit = F.col("rank") <= k
    return ranks.agg(
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hr"),
        F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("ndcg"),
        F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.count(F.lit(1)).alias("n_contexts"),
    )


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def losses(scored: DataFrame, pair_weight: float = 0.5) -> DataFrame:
    """Weighted binary cross-entropy of (context, score, y, weight, is_positive), and the pairwise loss of its positives.

    Rows that come with `positive_score`, the score of their context's only positive, are not joined with it.
    """
    bce = F.sum(F.col("weight") * (_softplus(F.col("score")) - F.col("y") * F.col("score"))) / F.sum("weight")
    if "positive_score" in scored.columns:
        pair = F.when(~F.col("is_positive"), _softplus(F.col("score") - F.col("positive_score")))
        both = scored.agg(bce.alias("bce"), F.avg(pair).alias("bpr"))
    else:
        positive = scored.where("is_positive").select("context", F.col("score").alias("p"))
        pairs = scored.where("NOT is_positive").join(positive, "context").agg(F.avg(_softplus(F.col("score") - F.col("p"))).alias("bpr"))
        both = scored.agg(bce.alias("bce")).crossJoin(pairs)
    return both.withColumn("loss", F.col("bce") + pair_weight * F.coalesce("bpr", F.lit(0.0)))
