"""Cross-entropy differences against models built with counters, each scored document left out of its own model."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from cadenza.llm import lm_scoring


def brute(docs, targets, background, k):
    split = [(i, (t or "").split()) for i, t in docs]
    size = 1 + len({w for _, words in split for w in words})

    def counts(words):
        pair = Counter(zip([None, *words], words))
        left = Counter()
        for (u, _), n in pair.items():
            left[u] += n
        return pair, left, Counter(words)

    models = []
    for members in (targets, background):
        total = [Counter(), Counter(), Counter()]
        for i, words in split:
            if i is not None and i in members:
                for a, b in zip(total, counts(words)):
                    a.update(b)
        models.append((members, total))
    out = []
    for i, words in split:
        ce = []
        for members, (pair, left, word) in models:
            own = counts(words) if i is not None and i in members else (Counter(), Counter(), Counter())
            n = sum(word.values()) - sum(own[2].values())
            loss = 0.0
            for u, v in zip([None, *words], words):
                p = (word[v] - own[2][v] + 1) / (n + size)
                loss -= math.log((pair[u, v] - own[0][u, v] + k * p) / (left[u] - own[1][u] + k))
            ce.append(loss / len(words) if words else None)
        out.append((str(i), len(words), *ce, ce[0] - ce[1] if words else None))
    return sorted(out, key=lambda r: r[:2])


def chosen(spark, docs, targets):
    """The ids of the background: as many others as there are targets, by hash."""
    ids = [i for i, _ in docs if i is not None]
    share = min(1.0, sum(i in targets for i in ids) / max(1, sum(i not in targets for i in ids)))
    frame = spark.createDataFrame([(i,) for i in set(ids) - targets], "i long")
    step = F.pmod(F.xxhash64("i"), F.lit(lm_scoring.STEPS))
    return {r.i for r in frame.where(step < int(lm_scoring.STEPS * share)).collect()}


def compare(spark, docs, targets, k, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumn("score", F.lit("a clashing column"))
    marks = spark.createDataFrame([(i,) for i in [*targets, *list(targets)[:1], 999_999, None]], "doc_id long")
    got = [(str(r.doc_id), r.n_tokens, r.ce_target, r.ce_background, r.score) for r in lm_scoring.score(df, marks, k=k).collect()]
    background = chosen(spark, docs, targets)
    expected = brute(docs, targets, background, k)
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=lambda r: r[:2]), expected, strict=True):
        assert a[:2] == b[:2]
        assert all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True))
    return background


def test_against_brute_force(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice("the of a b c d e f g h ü".split()) for _ in range(rng.randrange(1, 60)))) for k in range(60)]
    docs += [(70, None), (71, ""), (None, "the of"), (5, "second row of an id"), (72, "x " * 50000)]
    compare(spark, docs, {1, 2, 5, 72}, 2.0)


def test_background_is_of_the_size_of_the_targets(spark):
    docs = [(k, f"w{k % 7} w{k % 3}") for k in range(3000)]
    background = compare(spark, docs, set(range(0, 3000, 10)), 50.0)
    assert 240 < len(background) < 360 and not any(k % 10 == 0 for k in background)


def test_targets_are_told_from_others_they_were_not_counted_with(spark):
    """Held out: each document is scored by what the others of its kind say."""
    rng = random.Random(4)
    kinds = {0: [f"a{i}" for i in range(40)], 1: [f"b{i}" for i in range(40)]}
    docs = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(40))) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = {k for k in range(0, 400, 4)}  # half of the even ones
    scores = {r.doc_id: r.score for r in lm_scoring.score(df, spark.createDataFrame([(k,) for k in marked], "doc_id long")).collect()}
    unmarked_even = [scores[k] for k in range(2, 400, 4)]
    odd = [scores[k] for k in range(1, 400, 2)]
    assert max(scores[k] for k in marked) < min(odd) and max(unmarked_even) < min(odd)


def test_no_targets_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    none = df.select("doc_id").limit(0)
    out = {r.doc_id: r for r in lm_scoring.score(df, none).collect()}
    assert abs(out[1].ce_target - math.log(1 + 3)) < 1e-9 and abs(out[1].score) < 1e-12
    assert lm_scoring.score(df.limit(0), none).count() == 0
