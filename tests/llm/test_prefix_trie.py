"""The trie of conversations against one built with dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows, shared=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    if not shared:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:] if c % 5 else turns
    return out


def brute(rows, shared=True):
    convs = rebuilt(rows, shared)
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaf = [p for p in under if not any(len(q) == len(p) + 1 and q[:-1] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ids = ",".join(map(str, sorted(ends.get(path, []))))
        children = sum(1 for p in under if len(p) == len(path) + 1)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), children, len(leaf), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, convs=60, words=3, long=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        turns = rng.randint(1, long) if rng.random() < 0.7 else 2
        for t in rng.sample(range(20), turns):
            text = rng.choice(["", None, "é", "a", "bb"][:words + 1]) if rng.random() < 0.9 else f"own {c}.{t}"
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "user", "assistant", None]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 4 << 20), (2, 64), (3, 200)])
def test_nodes(spark, seed, size):
    """Also with ranges of a few sequences, so that most nodes reach over several."""
    rows = corpus(seed)
    found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), range_bytes=size)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_conversation_that_many_share(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 9000, 5) for t in range(3)]
    rows += [(c, t, "user", f"same {t}") for c in (1, 7) for t in range(6)]
    before, prefix_trie.PACK = prefix_trie.PACK, 100
    try:
        found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), shared=False, range_bytes=32)
    finally:
        prefix_trie.PACK = before
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, shared=False)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (1, 0, None, None), (1, 0, None, None), (3, None, "user", "a" * 100_000), (3, 5, "", ""), (-4, 1, "user", "x"), (10, 0, "r", "t")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("n", F.lit(None).cast("string"))
    found = prefix_trie.trie(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
    assert prefix_trie.trie(docs.limit(0)).collect() == []


def test_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(3000)] + [(5, t, "user", f"turn {t}" if t < 2990 else "other") for t in range(3000)]
    found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), range_bytes=100).where("depth >= 2988").orderBy("depth", "conv_id").collect()
    want = [(0, 2988, 2), (0, 2989, 2), (0, 2990, 2), *((c, d, 1) for d in range(2991, 3001) for c in (0, 5))]
    assert [(r.conv_id, r.depth, r.n_convs) for r in found] == want
    assert found[2].n_children == 2 and found[2].n_leaves == 2


def test_merge_keeps_lcps():
    rng = random.Random(4)
    turn = [bytes([i]) * prefix_trie.TURN for i in range(3)]
    seqs = list({b"".join(rng.choice(turn) for _ in range(rng.randint(0, 8))) for _ in range(300)})
    rng.shuffle(seqs)
    cuts = [0, 1, 40, 40, 170, len(seqs)]
    runs = list(zip(cuts, cuts[1:]))
    for a, b in runs:
        seqs[a:b] = sorted(seqs[a:b])
    lcps = [0, *(prefix_trie.common_turns(a, b) for a, b in zip(seqs, seqs[1:]))]
    merged = list(prefix_trie.merge(seqs, lcps, runs))
    order = [seqs[i] for i, _ in merged]
    assert order == sorted(seqs)
    assert [l for _, l in merged][1:] == [prefix_trie.common_turns(a, b) for a, b in zip(order, order[1:])]
