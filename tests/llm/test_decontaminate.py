import random

from pyspark.sql import functions as F

from cadenza.llm import decontaminate as d

WORD = set("0123456789abcdefghijklmnopqrstuvwxyz")


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in WORD or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        b = words(item)
        m = min(10, len(b))
        pats = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in pats:
                hit.update(range(i, i + m))
                if name is not None:
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def tables(spark):
    rng = random.Random(2)
    vocabulary = ["a", "B", "Éa", "x1", "the", "of"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([12, 25, 10, 3, 2, 1, 0, 11])]
    items[5] = (5, "unique-word")
    items += [(1, "repeated id with ten words that are not found before here"), (None, "null id words one two"), (99, None)]
    docs = [(k, ", ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 1500)))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "…!?"), (103, items[1][1].upper()), (103, items[1][1].upper()), (None, "null id words one two!")]
    docs.append((104, "filler " * 600 + items[8][1] + " filler" * 30000))
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items, df, bench = tables(spark)
    expected = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for block in (100_000, 20):
        got = d.search(df, bench, block_patterns=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == expected
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_drop_keeps_clean_rows_and_clashing_columns(spark):
    docs, items, df, bench = tables(spark)
    kept = d.drop_contaminated(df.selectExpr("*", "1 AS n_words", "'x' AS items", "2 AS hit_runs"), bench)
    assert kept.columns == ["doc_id", "text", "n_words", "items", "hit_runs"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in docs if not brute(t, items)[1]), key=str)
    assert d.search(df.limit(0), bench).count() == 0
    assert d.search(df, bench.limit(0)).where("contaminated").count() == 0


def test_drop_with_several_blocks(spark):
    docs, items, df, bench = tables(spark)
    kept = d.drop_contaminated(df.selectExpr("*", "1 AS _row", "'x' AS items"), bench, block_patterns=20)
    assert kept.columns == ["doc_id", "text", "_row", "items"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in docs if not brute(t, items)[1]), key=str)


def test_runs_of_several_blocks_are_united(spark):
    rows = [([0, 3, 2, 5, 9, 10],), ([5, 7, 0, 5],), ([],), ([4, 9, 5, 6, 9, 12, 20, 21],)]
    got = spark.createDataFrame(rows, "runs array<int>").select(d._united(F.col("runs")).alias("r")).collect()
    assert [r.r for r in got] == [[0, 5, 9, 10], [0, 7], [], [4, 12, 20, 21]]


def test_items_without_an_id_go_to_several_blocks(spark):
    rng = random.Random(8)
    items = [(None, " ".join(f"w{rng.randrange(10_000)}" for _ in range(12))) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(d._blocks(bench, "text", "item_id", d.WINDOW, 500))
    assert len(blocks) > 1 and all(len(holders) < 120 for _, holders in blocks)
    docs = [(k, f"before {t} after") for k, (_, t) in enumerate(items)] + [(99, "clean")]
    got = d.search(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_patterns=500).collect()
    assert {(r.doc_id, r.n_hit, r.n_items) for r in got} == {(k, 12, 0) for k in range(60)} | {(99, 0, 0)}
