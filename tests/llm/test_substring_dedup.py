import hashlib
import random

from cadenza.llm import substring_dedup as s


def brute(docs, window):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    vocabulary = ["a", "b", "Éé", "x1", "the", "of", " y", "zz"]
    text = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(n))
    passages = [text(n) for n in (13, 20, 40, 60)]
    docs = []
    for k in range(120):
        parts = [text(rng.randrange(0, 30))] + [rng.choice(passages) + " " + text(rng.randrange(0, 9)) for _ in range(rng.randrange(3))]
        docs.append((rng.randrange(1000), " ".join(parts)))
    docs += [docs[5], docs[6], (7000, docs[6][1]), (7000, docs[7][1]), (None, docs[8][1]), (7001, None), (7002, ""), (7003, "of " * 40)]
    docs += [(-5, passages[3]), (7004, "of " * 30000), (7005, passages[2] + "\x00 end")]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for window, anchor in ((13, 5), (4, 2)):
        got = s.remove_repeats(df, window=window, anchor=anchor).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(docs, window)
        assert all(sum(r.removed_runs[1::2]) - sum(r.removed_runs[::2]) == r.n_removed for r in got)


def test_kept_text_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "x a b c d y", 6)], "doc_id long, text string, n_words long")
    got = {r.doc_id: r for r in s.remove_repeats(df.selectExpr("*", "'q' AS anchor"), window=4, anchor=2, with_text=True).collect()}
    assert got[2].kept_text == "x y" and got[2].n_words == 6 and got[2].anchor == "q" and got[2].removed_runs == [1, 5]
    assert s.remove_repeats(df.limit(0)).count() == 0


def test_earliest_document_holds_an_anchor_at_several_places(spark):
    """Its words around one place are given; windows of another place, of another row of its id, and of documents that differ from it alike."""
    w = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    core = w("c", 9)
    docs = [
        (1, f"{w('a', 8)} {core} {w('b', 8)} {w('x', 20)} {w('d', 8)} {core} {w('e', 8)}"),
        (1, f"{w('f', 8)} {core} {w('g', 8)}"),
        (2, f"{w('d', 8)} {core} {w('b', 8)}"),
        (3, f"{w('f', 8)} {core} {w('h', 8)}"),
        (4, f"{w('k', 8)} {core} {w('h', 8)}"),
        (5, f"{w('k', 8)} {core} {w('e', 8)} {core} {w('g', 8)}"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for anchor in (3, 5):
        got = s.remove_repeats(df, anchor=anchor).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(docs, s.WINDOW)
