import random

from cadenza.llm import ngram_join as j


def shingles(text):
    w = (text or "").encode().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(docs):
    texts = {}
    for d, t in docs:
        if d is not None and shingles(t):
            texts.setdefault(t, []).append(d)
    sets = {t: shingles(t) for t in texts}
    links = {t: [u for u in sets if u != t and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])] for t in sets}
    group = {}
    for t in sets:
        if t in group:
            continue
        todo, members = [t], {t}
        while todo:
            for u in links[todo.pop()]:
                if u not in members:
                    members.add(u)
                    todo.append(u)
        least = min(d for u in members for d in texts[u])
        group |= {u: least for u in members}
    return sorted(((d, group[t], len(links[t])) if t in group and d is not None else (d, d, 0) for d, t in docs), key=str)


def corpus(seed=1, cluster=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(25), text(120).split()
    docs = [(k, passage + " " + text(rng.randrange(3, 90))) for k in range(150)]
    for k in range(cluster):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word()
        docs.append((1000 + k, rng.choice([" ", "\n"]).join(w)))
    for k in range(60):
        w = docs[rng.randrange(150)][1].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        docs.append((2000 + k, " ".join(w)))
    docs += [(3000 + k, docs[3][1]) for k in range(20)] + [(4000 + k, text(k)) for k in range(6)] + [(4100, "a b"), (4101, "a  b"), (4102, "b a")]
    return docs + [(5000, None), (5001, ""), (None, docs[3][1]), (6, docs[6][1]), (5002, text(20000)), (-7, docs[9][1])]


def test_all_links_against_brute_force(spark):
    for seed, options in ((1, {}), (2, {"limit": 8})):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS path")
        got = j.join_similar(df.repartition(3), **options).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(docs)


def test_one_of_each_group_stays(spark):
    docs = corpus(3, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "'s' AS source")
    kept = j.keep_one_each(df)
    assert kept.columns == ["doc_id", "text", "source"]
    expected = sorted((d for d, c, _ in brute(docs) if d == c), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == expected
    assert j.join_similar(df.limit(0)).count() == 0


def test_rows_of_one_id_go_by_their_own_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, b), (6, a), (6, b), (None, b), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in j.keep_one_each(docs).collect()), key=str)
    assert got == sorted([(1, b), (6, a), (None, b), (7, None)], key=str)


def test_large_buckets_of_near_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(j, "SKETCHES", 40)
    docs = corpus(5, 150)
    got = j.join_similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), limit=16).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(docs)
