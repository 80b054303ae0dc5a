"""Near-copies by b-bit MinHash against all pairs of sets, compared one by one."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import minhash_dedup
from cadenza.llm.tokens import U64, mix

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = SPACE.findall((text or "").translate(LOWER))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc -> (set size, component, kept), comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, doc = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            text = edited(rng, base, rng.randint(0, max(1, len(base) // 60)))
            rows.append((doc, " ".join(text) if rng.random() < 0.8 else "\t ".join(text).upper()))
            doc += 1
    shared = " ".join(word() for _ in range(60))
    for _ in range(40):  # a passage of many documents that makes none of them a near-copy
        rows.append((doc, shared + " " + " ".join(word() for _ in range(30))))
        doc += 1
    for text in ("", None, " \n\t", "one", "ONE", "one two three", "a b c d e", "A b c d E"):
        rows.append((doc, text))
        doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 512), (2, 8)])
def test_all_links(spark, seed, limit):
    rows = corpus(seed)
    found = minhash_dedup.find_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=limit)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_chain_without_a_common_copy(spark, monkeypatch):
    """Near-copies that drift: the ends of the chain are not similar, yet one component."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for doc in range(60):
        rows.append((doc, " ".join(words)))
        for at in rng.sample(range(200), 2):
            words[at] = f"v{doc}.{at}"
    monkeypatch.setattr(minhash_dedup, "PART", 2)
    found = minhash_dedup.find_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=4)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words here"), (1, "A B C D E F"), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cid", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(map(tuple, minhash_dedup.find_copies(docs).collect()), key=repr)
    want = [(1, 2, 1, True), (3, 1, 3, True), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (None, 0, None, True), (None, 2, None, True)]
    assert got == sorted(want, key=repr)
    assert minhash_dedup.find_copies(docs.limit(0)).collect() == []


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.85, 1.0):
        common = mix(rng.integers(0, 2**63, 2000).astype(U64))
        own = [np.concatenate([common[: int(2000 * share)], mix(rng.integers(0, 2**63, 2000 - int(2000 * share)).astype(U64), 9)]) for _ in "ab"]
        packed = [minhash_dedup.signatures(x, np.array([2000]), 32, 6)[1].view(np.int64)[0].tolist() for x in own]
        got = spark.createDataFrame([tuple(packed)], "a array<bigint>, b array<bigint>").select(minhash_dedup.estimate("a", "b", 192)).first()[0]
        true = share / (2 - share)
        assert abs(got - true) < 0.16


def test_very_long_text(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    other = edited(rng, words, 1000)
    far = edited(rng, words, 20_000)
    rows = [(2, " ".join(words)), (1, " ".join(other)), (0, " ".join(far))]
    found = minhash_dedup.find_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [(r.doc_id, r.component_id) for r in found.orderBy("doc_id").collect()] == [(0, 0), (1, 1), (2, 1)]
