import random

import numpy as np
import public_tokenizers
import tiktoken

from cadenza.llm import byte_bpe, packing

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODING = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute_fit(sizes, capacity):
    rooms, rows = [], []
    for p in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [room for room in rooms if room >= sizes[p]]
        if fit:
            best = max(r for r in range(len(rooms)) if rooms[r] == min(fit))
        else:
            best = len(rows)
            rooms.append(capacity)
            rows.append([])
        rooms[best] -= sizes[p]
        rows[best].append(p)
    return sorted(sum(sizes[p] for p in row) for row in rows)


def test_best_fit_by_segment_tree():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([1, 7, 8, 64, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(80))]
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
        filled = sorted(sum(sizes[p] for p in row) for row in rows)
        assert filled == brute_fit(sizes, capacity)


def test_lossless_round_trip(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice(["alpha", "été", "x", "\n\nб", "longer-word"]) for _ in range(rng.randrange(200)))) for k in range(80)]
    docs += [(None, "no id"), (500, None), (501, ""), (502, "word " * 3000), (3, "same id again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS pack")
    out = packing.pack(df.repartition(2), RANKS, public_tokenizers.PATTERN, capacity=128, group_tokens=2000, pad_id=50256).collect()
    pieces = {}
    for r in out:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 128 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((s, ids[a:b].tolist()))
    expected = {}
    for d, t in docs:
        expected.setdefault(d, []).append(ENCODING.encode_ordinary(t or ""))
    for d, lists in expected.items():
        got = sorted(pieces.get(d, []))
        if len(lists) == 1:
            assert [x for _, ids in got for x in ids] == lists[0]
        else:
            assert sorted(x for _, ids in got for x in ids) == sorted(x for ids in lists for x in ids)
    assert len({(r.pack, r.row) for r in out}) == len(out)
    assert packing.pack(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rows_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice(["alpha", "x", "б"]) for _ in range(rng.randrange(120)))) for k in range(120)] + [(7, "again"), (7, "again"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    results = []
    for parts in (1, 3, 8):
        out = packing.pack(df.repartition(parts), RANKS, public_tokenizers.PATTERN, capacity=64, group_tokens=700).collect()
        results.append(sorted(tuple(map(str, r)) for r in out))
    assert results[0] == results[1] == results[2]
    assert len({r[0] for r in results[0]}) > 2


def test_shards_are_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (5 * k % 90)) for k in range(90)], "doc_id long, text string")
    packed = packing.pack(docs, RANKS, public_tokenizers.PATTERN, capacity=32, group_tokens=500, pad_id=9)
    packing.write_shards(packed, str(tmp_path))
    want = {}
    for r in packed.orderBy("pack", "row").collect():
        want.setdefault(r.pack, []).append(r)
    index = spark.read.parquet(f"{tmp_path}/index").orderBy("pack").collect()
    assert [r.pack for r in index] == sorted(want) and len(index) > 1
    total = 0
    for entry in index:
        rows = want[entry.pack]
        shard = packing.read_shard(spark, str(tmp_path), entry.pack, 32)
        assert shard["input_ids"].shape == shard["position_ids"].shape == (entry.n_rows, 32) == (len(rows), 32)
        for k, r in enumerate(rows):
            assert shard["input_ids"][k].tobytes() == r.input_ids and shard["position_ids"][k].tobytes() == r.position_ids
            assert shard["cu_seqlens"][k] == r.cu_seqlens and shard["doc_ids"][k] == r.doc_ids and shard["starts"][k] == r.starts
        assert (entry.tokens_before, entry.n_tokens) == (total, sum(r.n_tokens for r in rows))
        total += entry.n_tokens
