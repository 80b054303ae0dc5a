"""Percentiles by selection, numbers over ranges, K-means by aggregates, searches and parsers against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import features, monitoring, search, tables
from cadenza.sources.shared import numbered
from cadenza.streaming import lookup


@pytest.mark.parametrize("few", [50_000, 0])
def test_places_of_sorted_values(spark, few):
    """Close values, repeated values, one huge value, one value, negative ones; bounds sent to all tasks or shuffled."""
    rng = random.Random(1)
    groups = {
        "close": [1 + k * 1e-15 for k in range(200)],
        "repeated": [5.0] * 300 + [7.0, 8.0],
        "huge": [rng.random() for _ in range(500)] + [1e300],
        "one": [3.5],
        "negative": [-rng.random() * 1e6 for _ in range(101)] + [0.0, 4.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("close", None), ("none", None)]
    rng.shuffle(rows)
    before, monitoring.FEW_GROUPS = monitoring.FEW_GROUPS, few
    try:
        frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
        got = monitoring.nearest_rank(frame, "v", {"p0": 0, "p50": 50, "p95": 95, "p100": 100}, ["g"])
        found = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in got.collect()}
        middle = {r.g: r.m for r in monitoring.median(frame, "v", ["g"], "m").collect()}
        whole = monitoring.median(frame, "v", [], "m").collect()
    finally:
        monitoring.FEW_GROUPS = before
    at = lambda values, p: sorted(values)[round(p / 100 * (len(values) - 1))]
    assert found == {g: tuple(at(v, p) for p in (0, 50, 95, 100)) for g, v in groups.items()}
    centre = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    assert middle == {g: centre(v) for g, v in groups.items()}
    assert [r.m for r in whole] == [centre([v for values in groups.values() for v in values])]
    assert monitoring.median(frame.limit(0), "v", ["g"], "m").collect() == []


def test_numbers_over_ranges(spark):
    values = random.Random(2).sample(range(10_000), 500)
    frame = spark.createDataFrame([(v % 7 if v % 3 else None, v) for v in values], "a int, b int").repartition(5)
    got = {(r.a, r.b): r.n for r in numbered(frame, ["a", "b"], "n").collect()}
    order = sorted(((v % 7 if v % 3 else None, v) for v in values), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == {key: i for i, key in enumerate(order)}
    assert numbered(frame.limit(0), ["a", "b"], "n").collect() == []


def kmeans(points, k, rounds=20):
    """(centroid, size) of each cluster, from (track, copies, vector)."""
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    seeds = [min(points, key=lambda p: (hashlib.md5(str(p[0]).encode()).hexdigest(), p[0]))[2]]
    while len(seeds) < k:
        far = max(points, key=lambda p: (min(d(p[2], s) for s in seeds), -p[0]))
        if min(d(far[2], s) for s in seeds) == 0:
            break
        seeds.append(far[2])
    near = lambda v: min(range(len(seeds)), key=lambda i: (d(v, seeds[i]), i))
    for _ in range(rounds):
        new = []
        for i, old in enumerate(seeds):
            own = [p for p in points if near(p[2]) == i]
            n = sum(p[1] for p in own)
            new.append([sum(p[1] * p[2][x] for p in own) / n for x in range(len(old))] if own else old)
        if new == seeds:
            break
        seeds = new
    sizes = [sum(p[1] for p in points if near(p[2]) == i) for i in range(len(seeds))]
    return [(i, [round(x, 6) for x in s], n) for i, (s, n) in enumerate(zip(seeds, sizes)) if n]


def test_kmeans_of_all_users_at_once(spark):
    rng = random.Random(6)
    vectors = {t: [rng.choice([0.0, 5.0]) + rng.random(), rng.random(), rng.choice([-3.0, 3.0])] for t in range(40)}
    vectors |= {100: [1.0, 1.0, 1.0], 101: [1.0, 1.0, 1.0], 102: [1.0, 1.0, 1.0]}
    taste = {u: {t: rng.randint(1, 4) for t in rng.sample(range(40), size)} for u, size in ((1, 1), (2, 3), (3, 12), (4, 30))}
    taste |= {5: {100: 5, 101: 5, 102: 9}, 6: {7: 1}, 7: {999: 8}}
    frame = spark.createDataFrame([(u, t, c) for u, own in taste.items() for t, c in own.items()], "user_id long, track_id long, copies long")
    emb = spark.createDataFrame(list(vectors.items()), "track_id long, embedding array<double>")
    got = {}
    for r in sorted(features.kmeans_centroids(frame, emb, bounds=(6, 30)).collect(), key=lambda r: (r.user_id, r.centroid_idx)):
        got.setdefault(r.user_id, []).append((r.centroid_idx, [round(x, 6) for x in r.centroid], r.cluster_size))
    want = {}
    for u, own in taste.items():
        points = [(t, c, vectors[t]) for t, c in own.items() if t in vectors]
        n = sum(p[1] for p in points)
        if n >= 2:
            want[u] = kmeans(points, 1 if n < 6 else 2 if n <= 30 else 3, 20 if n >= 6 else 1)
    assert got == want
    assert len(got[5]) == 1  # equal vectors make one cluster


def test_long_term_taste_has_three_branches(spark):
    centroids = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [4.0, 0.0]), (2, 0, [9.0, 9.0])], "user_id long, centroid_idx int, centroid array<double>")
    tracks = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 8), (2, 20, 8), (3, 30, 1)], "user_id long, session_id long, track_id long")
    emb = spark.createDataFrame([(1, [2.0, 1.0]), (2, [5.0, -1.0])], "track_id long, embedding array<double>")
    got = features.long_term(features.session_means(tracks, emb), centroids).orderBy("session_id").collect()
    assert [(r.session_id, r.centroid_idx, r.distance, r.u_long) for r in got] == [
        (10, 1, 0.5, [4.0, 0.0]),
        (11, 0, None, [0.0, 0.0]),
        (20, 0, None, [9.0, 9.0]),
        (30, None, None, None),
    ]


def test_first_term_with_hits_and_marker(spark):
    songs = [("s2", "Blue rod", "a/7.mp3", "X", "Ann"), ("s1", "blue ROD live", "a/8.mp3", None, "Bob"), ("s3", "Other", "b/9.mp3", "Y", "Bob Ann")]
    frame = spark.createDataFrame(songs, "id string, title string, path string, album string, artist string")
    rows = [("7", ["zzz", "rod blue", "ann"]), ("5", ["", "  ", "BLUE"]), ("6", ["none here", None]), ("9", ["ann bob"]), ("4", ["!!!", "other song", "y"])]
    got = search.term_search(spark.createDataFrame(rows, "track_id string, terms array<string>"), frame).collect()
    assert {r.track_id: (r.term, r.song_id, r.marked) for r in got} == {
        "7": ("rod blue", "s2", True),
        "5": ("BLUE", "s1", False),
        "6": (None, None, None),
        "9": ("ann bob", "s3", True),
        "4": ("y", "s3", False),
    }


@pytest.mark.parametrize("most", [10, 0])
def test_lookup_keeps_misses(spark, most):
    before, lookup.MOST_SENT = lookup.MOST_SENT, most
    try:
        events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "event_id long, nav_id string")
        mapping = spark.createDataFrame([("a", 7), ("c", 8)], "nav_id string, track_id long")
        assert sorted((r.event_id, r.track_id) for r in lookup.with_tracks(events, mapping).collect()) == [(1, 7), (2, None), (3, None)]
    finally:
        lookup.MOST_SENT = before


def test_update_takes_the_columns_that_there_are(spark):
    spark.createDataFrame([(1, "f1", "old", "k"), (2, "f2", "k2", "k"), (3, "f9", "k9", "k")], "id int, path string, title string, label string").createOrReplaceTempView("media_under_test")
    meta = spark.createDataFrame([("f1", "k1", "New"), ("f2", "x", "k1"), ("f0", "k1", "Last"), ("f0", "k2", "Title2")], "filename string, track_key string, title string")
    try:
        got = tables.updated_from_matches(spark, "media_under_test", meta, {"title": "title", "album": "title"})
        assert got.columns == ["id", "path", "title", "label"]
        assert sorted(map(tuple, got.collect())) == [(1, "f1", "New", "k"), (2, "f2", "Last", "k"), (3, "f9", "k9", "k")]
    finally:
        spark.catalog.dropTempView("media_under_test")


def test_windows_and_times_of_texts(spark):
    assert [monitoring.window_length(x) for x in ("5m", "1H", " 12d ")] == ["5 MINUTES", "1 HOURS", "12 DAYS"]
    for bad in ("5", "m", "5s", "x5m", ""):
        with pytest.raises(ValueError):
            monitoring.window_length(bad)
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "soon", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(monitoring.parsed_time(F.col("t")).cast("string").alias("t"))
    assert [r.t for r in frame.collect()] == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", None, None, None]


def test_records_and_optional_conditions(spark):
    rows = spark.createDataFrame([(1, "a" * 20, "x", True, "available"), (2, "b", None, True, "quarantined")], "track_id long, title string, artist string, is_playable boolean, availability_status string")
    got = [r.record for r in tables.track_records(rows).orderBy("track_id").collect()]
    assert got == ['{"track_id":"1","title":"aaaaaaaaaaa…","artist":"x","playable":true}', '{"track_id":"2","title":"b","playable":false}']
    assert tables.where_given(rows, {"artist": None, "is_playable": None}).count() == 2
    assert tables.where_given(rows, {"artist": "x", "title": None}).count() == 1
    assert sorted(r.track_id for r in tables.first_keys(rows.unionByName(rows), "track_id", 1).collect()) == [1, 1]


@pytest.mark.parametrize("few", [0, 32])
def test_terms_of_many_rows_and_songs_are_not_met_by_pairs(spark, monkeypatch, few):
    """As pair by pair, also for ids with other characters, ids within words and ids of no song; no row for each row and song."""
    monkeypatch.setattr(search, "FEW", few)
    songs = [(f"nav{k:03}", f"blue {k % 7}", f"a/{k}x.mp3", None, "Ann") for k in range(60)]
    ids = [*(str(k) for k in range(0, 90, 3)), "A/5", "4X", "zz", "nn", ""]
    frame = spark.createDataFrame(songs, "id string, title string, path string, album string, artist string")
    got = search.term_search(spark.createDataFrame([(t, ["none", "blue"]) for t in ids], "track_id string, terms array<string>"), frame)
    texts = {s[0]: " ".join(x or "" for x in s).lower() for s in songs}
    want = {t: min((t.lower() not in texts[s], s) for s in texts) for t in ids}
    assert {r.track_id: (not r.marked, r.song_id) for r in got.collect()} == want
