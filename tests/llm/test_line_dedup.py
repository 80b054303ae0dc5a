import random

from cadenza.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, min_fuzzy):
    lines, split = [], []
    for d, t in docs:
        own = (t or "").split("\n")
        split.append((d, own))
        if d is not None:
            n = 0
            for x in own:
                if x.strip(" \t\n\x0b\x0c\r"):
                    lines.append((d, n, x))
                    n += 1
    first = {}
    for d, n, x in lines:
        first[x] = min(first.get(x, (d, n)), (d, n))
    out = []
    for d, own in split:
        left, seen, total, gone = [], set(), 0, 0
        for x in own:
            if x.strip(" \t\n\x0b\x0c\r"):
                total += 1
                if d is not None:
                    near = any(
                        min(len(x), len(y)) >= min_fuzzy and abs(len(x) - len(y)) <= 1 and p < first[x] and distance(x, y) <= 1
                        for y, p in first.items()
                        if y != x
                    )
                    if near or first[x][0] != d or x in seen:
                        gone += 1
                        continue
                    seen.add(x)
            left.append(x)
        out.append((d, "\n".join(left), total, gone))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    base = [line(rng.randrange(1, 24)) for _ in range(25)] + ["a" * 12, "ab" * 6, "a" * 13]
    docs = []
    for k in range(90):
        own = []
        for _ in range(rng.randrange(0, 6)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(x) + 1)
                x = rng.choice([x[:i] + rng.choice("abé") + x[i:], x[:i] + x[i + 1 :], x[:i] + "b" + x[i + 1 :]])
            own += [x] + rng.choice([[], [""], ["  "]])
        docs.append((k * 3 % 101, "\n".join(own)))
    return docs + [(None, base[0] + "\n" + base[0]), (300, None), (301, ""), (302, "\n\n"), (303, base[3] + "\r\n"), (304, "x" * 60000)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS line", "'z' AS n_lines")
        got = ld.remove_lines(df.repartition(3)).collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute(docs, ld.MIN_FUZZY)
        assert all(r.line == 7 for r in got)


def test_exact_only_repeated_rows_and_emptied_documents(spark):
    docs = [(1, "hello world one\nb"), (1, "hello world one\nb"), (2, "hello world one\nhello world on"), (3, "b"), (4, None)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_chars long")
    exact = sorted((r.doc_id, r.text) for r in ld.remove_lines(df, max_edits=0).collect())
    assert exact == [(1, docs[0][1]), (1, docs[0][1]), (2, "hello world on"), (3, ""), (4, "")]
    kept = ld.keep_first_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.n_chars) for r in kept.collect()) == [(1, 17), (1, 17), (4, 0)]
    assert ld.remove_lines(df.limit(0)).count() == 0


def test_within_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert ld.within_one_edit(x, y) == (distance(x, y) <= 1)
