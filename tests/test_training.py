import hashlib
import math
import random
from fractions import Fraction

import pytest

from cadenza.operators import features, training
from cadenza.plans import registry

HARD = "session_id long, t int, candidate long"


def drawn(spark, weights, hard):
    found = spark.createDataFrame([(s, 0, s % 3 + 1) for s in range(40)], "session_id long, t int, anchor long")
    weights = spark.createDataFrame(weights, "track_id long, weight double")
    rows = training.random_negatives(found, weights, spark.createDataFrame(hard, HARD)).collect()
    out = {s: [] for s in range(40)}
    for r in sorted(rows, key=lambda r: (r.session_id, r["rank"])):
        out[r.session_id].append(r.candidate)
        assert r["rank"] == len(out[r.session_id])
    return out


@pytest.mark.parametrize("hot", [0.5, 0.999999])
def test_every_context_reaches_its_number(spark, hot):
    """One track with nearly all the weight, over two ranges of track numbers."""
    tracks = [1, 2, 3, 4, 5, 6, 7, 5000, 9000, 9001]
    weights = [(k, hot if k == 5000 else (1 - hot) / 9) for k in tracks]
    hard = [(s, 0, c) for s in range(0, 40, 2) for c in (4, 5)]
    out = drawn(spark, weights, hard)
    for s, got in out.items():
        gone = {s % 3 + 1} | {c for h, _, c in hard if h == s}
        assert len(got) == len(set(got)) == 5 - (len(gone) - 1)
        assert set(got) <= set(tracks) - gone


def test_small_vocabulary_gives_all_it_has(spark):
    out = drawn(spark, [(k, 0.25) for k in range(1, 5)], [(0, 0, 4)])
    assert all(set(got) == {1, 2, 3, 4} - {s % 3 + 1} - ({4} if s == 0 else set()) for s, got in out.items())


def test_query_reaches_the_number_with_the_hard_ones(spark):
    query = registry.queries()
    got, hard = (query[n](spark, "/root/testdata/sf0.001").collect() for n in ("random_negatives", "contexts_with_hard_negs"))
    found = {}
    for r in [*got, *hard]:
        found.setdefault((r.session_id, r.t), []).append(r.candidate)
    assert all(len(c) == len(set(c)) == 5 for c in found.values())


def test_losses_with_and_without_the_positive_score(spark):
    schema = "context string, score double, y double, weight double, is_positive boolean, positive_score double"
    rows = [("a", 1.0, 1.0, 0.3, True, 1.0), ("a", 0.5, 0.0, 1.0, False, 1.0), ("a", -1.5, 0.0, 1.0, False, 1.0), ("c", None, 0.0, 1.0, None, None), ("d", 0.0, 1.0, 2.0, True, 0.0), ("d", 1.5, 0.0, 1.0, False, 0.0)]
    scored = spark.createDataFrame(rows, schema)
    soft = lambda x: max(x, 0) + math.log1p(math.exp(-abs(x)))
    bce = sum(w * (soft(s) - y * s) for _, s, y, w, _, _ in rows if s is not None) / sum(r[3] for r in rows)
    bpr = (soft(-0.5) + soft(-2.5) + soft(1.5)) / 3
    for found in (training.losses(scored), training.losses(scored.drop("positive_score"))):
        assert list(found.first()) == pytest.approx([bce, bpr, bce + 0.5 * bpr])
    assert training.losses(scored.where("is_positive")).first().bpr is None


def test_losses_read_the_plays_twice(spark):
    """Once for the contexts, once for the edges: no context is joined with its own rows."""
    plan = registry.queries()["losses_bce_bpr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 2


def test_places_of_weights_are_exact_and_the_same_however_rows_are_dealt(spark):
    """Sums of doubles depend on the order of the rows; a draw between two of their results goes to another track."""
    rng = random.Random(8)
    counts = [(t, rng.randint(1, 60)) for t in range(9_000)]
    frame = spark.createDataFrame(counts, "track_id long, track_count long")
    seen = []
    for parts in (1, 3, 7):
        weights = features.negative_weights(frame, frame.repartition(parts)).repartition(parts)
        spans = training._spans(weights, 64).select("candidate", "from", "to").distinct().collect()
        seen.append(sorted((r.candidate, r["from"], r["to"]) for r in spans))
        exact, low = {r.track_id: Fraction(r.weight) for r in weights.collect()}, Fraction(0)
        for t, start, end in seen[-1]:
            assert abs(start - float(low)) <= math.ulp(start) and abs(end - float(low + exact[t])) <= math.ulp(end)
            low += exact[t]
    assert seen[0] == seen[1] == seen[2]


def test_few_draws_are_made_at_first_and_the_result_is_that_of_all(spark):
    """Contexts that are short after the first draws go on with the same tries, so the order of the tries decides as before."""
    found = spark.createDataFrame([(s, t, 10, s % 4) for s in range(40) for t in range(2)], "session_id long, t int, last long, anchor long")
    weights = spark.createDataFrame([(k, w) for k, w in enumerate((0.4, 0.3, 0.1, 0.1, 0.06, 0.04))], "track_id long, weight double")
    got = {}
    for r in training.random_negatives(found, weights, n=3).orderBy("session_id", "t", "rank").collect():
        got.setdefault((r.session_id, r.t), []).append(r.candidate)
    bounds = [0.0, 0.4, 0.7, 0.8, 0.9, 0.96, 1.0]
    for s in range(40):
        for t in range(2):
            want = []
            for k in range(1, 601):
                u = int(hashlib.md5(f"{s}:{t}:{k}".encode()).hexdigest()[:13], 16) / 2**52
                c = max(i for i in range(6) if bounds[i] <= u)
                if c != s % 4 and c not in want and len(want) < 3:
                    want.append(c)
            assert got[s, t] == want
