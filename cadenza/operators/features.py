"""Offline features: splits, popularity, co-occurrence graphs, taste rows and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import squared_distance
from cadenza.sources.shared import numbered, stored

LIKED = ("positive", "neutral")


def hash_ranks(rows: DataFrame, key: str, seed: str = "") -> DataFrame:
    """(key, rank, n): the distinct keys numbered from 0 in the order of their MD5, and their number.

    The rank of a key is its rank among the keys of its hash prefix plus the number of keys with smaller prefixes, so
    no task ranks all keys.
    """
    hashed = rows.select(key).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")))
    hashed = hashed.withColumn("prefix", F.substring("h", 1, 3))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("prefix").agg(F.count(F.lit(1)).alias("c"))  # at most 4096 rows
    sizes = sizes.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    ranked = hashed.withColumn("rn", F.row_number().over(Window.partitionBy("prefix").orderBy("h", key)))
    return ranked.join(F.broadcast(sizes), "prefix").select(key, (F.col("base") + F.col("rn") - 1).alias("rank"), "n")


def split_sessions(sessions: DataFrame, key: str = "session_id", train: float = 0.75, val: float = 0.125, seed: str = "") -> DataFrame:
    """(key, part): a shuffle by MD5, cut into floor(n * share) train and val rows, the rest test."""
    n, rank = F.col("n"), F.col("rank")
    part = F.when(rank < F.floor(n * train), "train").when(rank < F.floor(n * train) + F.floor(n * val), "val").otherwise("test")
    return hash_ranks(sessions, key, seed).select(key, part.alias("part"))


def popularity(plays: DataFrame) -> DataFrame:
    counts = plays.groupBy("track_id").agg(F.count(F.lit(1)).alias("track_count"))
    return counts.withColumn("pop_score", F.log1p("track_count"))


def first_seen_index(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, row_idx): distinct keys numbered from 0 by their first ordinal."""
    first = rows.groupBy(key).agg(F.min(ordinal).alias("_first"))
    return numbered(first, ["_first", key], "row_idx").select(key, F.col("row_idx").cast("bigint"))


def transitions(tracks: DataFrame, vocabulary: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): neighbours in a session after skipped plays are left out.

    The vocabulary applies after the neighbours are known: an unknown track breaks a transition.
    """
    edges = transition_rows(tracks, sessions).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return edges if vocabulary is None else within(edges, vocabulary)


def transition_rows(tracks: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight and, if `tracks` has it, the tag of dst): `transitions` one by one, each with the weight 1."""
    liked = tracks.where(F.col("label").isin(*LIKED))
    if sessions is not None:
        liked = liked.join(sessions, "session_id", "left_semi")
    order = Window.partitionBy("session_id").orderBy("position")
    tag = [F.lead("tag").over(order).alias("tag")] if "tag" in tracks.columns else []
    rows = liked.select(F.col("track_id").alias("src"), F.lead("track_id").over(order).alias("dst"), F.lit(1.0).alias("weight"), *tag)
    return rows.where("dst IS NOT NULL")


def within(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges with both ends in the vocabulary."""
    known = vocabulary.select("track_id")
    return edges.join(known.withColumnRenamed("track_id", "src"), "src", "left_semi").join(known.withColumnRenamed("track_id", "dst"), "dst", "left_semi").select(*edges.columns)


def playlist_cooccurrence(entries: DataFrame, reach: int = 5) -> DataFrame:
    """(src, dst, weight), both ways: the sum of 1 / distance over pairs within `reach` places and 1..reach positions.

    One window with `reach` leads instead of a self-join: a playlist is shuffled once.
    """
    order = Window.partitionBy("playlist_id").orderBy("place")
    ahead = F.array(*[F.struct(F.lead("track_id", k).over(order).alias("t"), F.lead("position", k).over(order).alias("p")) for k in range(1, reach + 1)])
    pairs = entries.withColumn("_ahead", ahead).select("track_id", "position", F.explode("_ahead").alias("o"))
    gap = F.col("o.p") - F.col("position")
    pairs = pairs.where(F.col("o.t").isNotNull() & gap.between(1, reach)).select(F.col("track_id").alias("a"), F.col("o.t").alias("b"), (1.0 / gap).alias("w"))
    once = pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e"))
    return both.groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.sum("e.w").alias("weight"))


def graph_stats(edges: DataFrame, n_tracks: Column) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("nnz"), F.sum("weight").alias("total_weight")).withColumn("density", F.col("nnz") / (n_tracks * n_tracks))


def top_neighbours(edges: DataFrame, k: int = 3, loops: bool = False) -> DataFrame:
    """The k heaviest ends of every src, itself only with `loops`; ties by dst."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return (edges if loops else edges.where("src <> dst")).withColumn("rank", rank).where(F.col("rank") <= k)


def negative_weights(vocabulary: DataFrame, counts: DataFrame, power: float = 0.75) -> DataFrame:
    """(track_id, weight): count ** power over the vocabulary, unseen tracks counting 1, scaled to a sum of 1. The sum is one of decimals: the same however the rows are dealt."""
    raw = vocabulary.select("track_id").join(counts.select("track_id", "track_count"), "track_id", "left")
    raw = raw.select("track_id", F.pow(F.coalesce("track_count", F.lit(1)), F.lit(power)).alias("w"))
    total = raw.agg(F.sum(F.col("w").cast("decimal(38, 18)")).cast("double").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("track_id", (F.col("w") / F.col("total")).alias("weight"))


def last_positives(tracks: DataFrame, n: int = 300) -> DataFrame:
    """The n last positive plays of each user by (session_id, position); `rank` 1 is the last."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("session_id"), F.desc("position")))
    return tracks.where("label = 'positive'").withColumn("rank", rank).where(F.col("rank") <= n).select("user_id", "track_id", "rank")


def taste_rows(loved: DataFrame, positives: DataFrame, embeddings: DataFrame, loved_weight: int = 3) -> DataFrame:
    """(user_id, track_id, copies): loved tracks count `loved_weight` times, positive plays once; only embedded tracks."""
    rows = loved.select("user_id", "track_id", F.lit(loved_weight).cast("bigint").alias("copies")).unionByName(
        positives.select("user_id", "track_id", F.lit(1).cast("bigint").alias("copies"))
    )
    return rows.join(embeddings.select("track_id"), "track_id", "left_semi").groupBy("user_id", "track_id").agg(F.sum("copies").alias("copies"))


def weighted_means(rows: DataFrame, keys: list[str], dimensions: int, vector: str = "vector", weight: str = "copies") -> DataFrame:
    """(keys…, size, mean): the sum of the weights and the weighted mean vector; one row for each key and task is shuffled."""
    sums = [F.sum(F.col(vector)[i].cast("double") * F.col(weight)).alias(f"_{i}") for i in range(dimensions)]
    found = rows.groupBy(*keys).agg(F.sum(weight).cast("bigint").alias("size"), *sums)
    return found.select(*keys, "size", F.array(*[F.col(f"_{i}") / F.col("size") for i in range(dimensions)]).alias("mean"))


def dimensions_of(embeddings: DataFrame) -> int:
    """The length of the vectors, from one of them; 0 without any."""
    row = embeddings.select(F.size("embedding")).first()
    return row[0] if row else 0


def mean_centroids(taste: DataFrame, embeddings: DataFrame, least: int = 2) -> DataFrame:
    """(user_id, size, dim, value): the weighted mean vector of users with `least` rows or more, one row per dimension."""
    means = weighted_means(taste.join(embeddings, "track_id"), ["user_id"], dimensions_of(embeddings), "embedding")
    return means.where(F.col("size") >= least).select("user_id", "size", F.posexplode("mean").alias("dim", "value"))


def _nearest(vector: Column, centroids: Column) -> Column:
    """(distance, idx) of the nearest of an array of vectors; the first of equally near ones."""
    return F.array_min(F.transform(centroids, lambda c, i: F.struct(squared_distance(vector, c).alias("distance"), i.alias("idx"))))


def kmeans_centroids(taste: DataFrame, embeddings: DataFrame, bounds: tuple[int, int] = (100, 300), rounds: int = 20) -> DataFrame:
    """(user_id, centroid_idx, centroid, cluster_size): K-means of each user's weighted rows, all users at once.

    K is 1 below the first of `bounds` rows, 2 up to the second, else 3; users of one row have none. The first seed is the track of least MD5, each further
    one the track farthest from those before it (none if all lie on these; ties: the smaller id). A round assigns every
    track to the nearest centroid and takes the weighted means, both as joins and aggregates by user and cluster; an empty cluster keeps its
    centroid. It ends when no centroid changes, after `rounds` rounds at most. Clusters without a track at the end are left out.
    """
    n = dimensions_of(embeddings)
    sizes = taste.join(embeddings.select("track_id"), "track_id").groupBy("user_id").agg(F.sum("copies").alias("n")).where("n >= 2")
    k = F.when(F.col("n") < bounds[0], 1).when(F.col("n") <= bounds[1], 2).otherwise(3)
    points = taste.join(sizes.select("user_id", k.alias("k")), "user_id").join(embeddings, "track_id")
    points = stored(points.select("user_id", "track_id", "copies", "k", F.col("embedding").cast("array<double>").alias("vector")), "points")
    single = weighted_means(points.where("k = 1"), ["user_id"], n).select("user_id", F.lit(0).alias("centroid_idx"), F.col("mean").alias("centroid"), F.col("size").alias("cluster_size"))

    several = points.where("k > 1")
    now = several.groupBy("user_id").agg(F.array(F.min_by("vector", F.struct(F.md5(F.col("track_id").cast("string").cast("binary")), "track_id"))).alias("centroids"))
    for count in (2, 3):
        far = several.where(F.col("k") >= count).join(now, "user_id").withColumn("d", _nearest(F.col("vector"), F.col("centroids"))["distance"])
        far = far.groupBy("user_id").agg(F.max_by(F.struct("vector", "d"), F.struct("d", -F.col("track_id"))).alias("far")).where("far.d > 0")
        now = now.join(far, "user_id", "left").select("user_id", F.when(F.col("far").isNull(), F.col("centroids")).otherwise(F.concat("centroids", F.array("far.vector"))).alias("centroids"))
    now = stored(now, "centroids")
    assigned = lambda: several.join(now, "user_id").withColumn("idx", _nearest(F.col("vector"), F.col("centroids"))["idx"])
    for _ in range(rounds):
        means = weighted_means(assigned(), ["user_id", "idx"], n).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "mean"))).alias("means"))
        new = now.join(means, "user_id").select("user_id", "centroids", F.transform("centroids", lambda c, i: F.coalesce(F.try_element_at("means", i), c)).alias("new"))
        new = stored(new, "centroids")
        moved = not new.where("centroids <> new").isEmpty()
        now = new.select("user_id", F.col("new").alias("centroids"))
        if not moved:
            break
    at = assigned().groupBy("user_id", F.col("idx").alias("centroid_idx")).agg(F.sum("copies").cast("bigint").alias("cluster_size"))
    several = at.join(now, "user_id").select("user_id", "centroid_idx", F.get("centroids", F.col("centroid_idx")).alias("centroid"), "cluster_size")
    return single.unionByName(several)


def session_means(tracks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(user_id, session_id, vector): every session with the mean vector of its embedded tracks, null if it has none."""
    known = tracks.join(embeddings, "track_id").withColumn("copies", F.lit(1))
    means = weighted_means(known, ["session_id"], dimensions_of(embeddings), "embedding").select("session_id", F.col("mean").alias("vector"))
    return tracks.select("user_id", "session_id").distinct().join(means, "session_id", "left").select("user_id", "session_id", "vector")


def long_term(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """`points` (user_id, key…, vector) with centroid_idx, distance and u_long, the vector of the user's long-term taste.

    The nearest centroid; that of number 0 without a distance where the point has no vector; all null for a user without any.
    """
    every = centroids.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("centroid_idx", "centroid"))).alias("c"))
    near = F.array_min(F.transform("c", lambda c: F.struct(squared_distance(F.col("vector"), c["centroid"]).alias("d"), c["centroid_idx"].alias("i"), c["centroid"].alias("v"))))
    found = points.join(every, "user_id", "left").withColumn("n", F.when(F.col("vector").isNotNull(), near)).withColumn("first", F.get("c", F.lit(0)))
    return found.select(
        *points.columns,
        F.coalesce("n.i", "first.centroid_idx").alias("centroid_idx"),
        F.sqrt("n.d").alias("distance"),
        F.coalesce("n.v", "first.centroid").alias("u_long"),
    )


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(key..., centroid_idx, distance): the nearest of a user's centroids for each (user_id, key, vector); ties by number."""
    near = points.join(centroids, "user_id").withColumn("distance", F.sqrt(squared_distance(F.col("vector"), F.col("centroid"))))
    keys = [c for c in points.columns if c != "vector"]
    best = near.groupBy(*keys).agg(F.min(F.struct("distance", "centroid_idx")).alias("b"))
    return best.select(*keys, F.col("b.centroid_idx").alias("centroid_idx"), F.col("b.distance").alias("distance"))


def vector_or_zero(rows: DataFrame, vectors: DataFrame, key: str, dimensions: int) -> DataFrame:
    """`rows` with `vector`, a zero vector where `vectors` (key, embedding) has none, and `known`."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    found = rows.join(vectors.select(key, F.col("embedding").cast("array<double>").alias("vector")), key, "left")
    return found.withColumn("known", F.col("vector").isNotNull()).withColumn("vector", F.coalesce("vector", zero))
