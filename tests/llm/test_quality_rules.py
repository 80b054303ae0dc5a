import random
import re

from pyspark.sql import functions as F

from cadenza.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "😀", "#", "<", " ", " ", "\n", "\t", "\x0b", "ab "]) for _ in range(rng.randrange(250))) for _ in range(80)]
    texts += ["", None, " \n ", "a b c " * 40, " ".join(f"w{i % 97}" for i in range(400)), "x" * 20_000]
    return [(k, t, rng.choice(["h1", "h2", None])) for k, t in enumerate(texts)] + [(3, texts[3], "h1"), (None, None, None)]


def test_measures_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    got = qr.judge(df).select("doc_id", *qr.MEASURES, "base_failed").collect()
    expected = []
    for i, t, _ in docs:
        m = brute(t)
        expected.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_hosts_of_failures_are_rejected_and_empty_table(spark):
    good = " ".join(f"word{i}" for i in range(80))
    symbols = " ".join(f"a#<>$%{i}" for i in range(80))
    docs = [(i, good, "good.example") for i in range(30)] + [(100 + i, symbols, "bad.example") for i in range(30)]
    docs += [(200, good, "bad.example"), (201, symbols, "good.example"), (202, symbols, None), (203, "short", "good.example")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r.doc_id for r in qr.judge(df).where("kept").collect()}
    assert kept == {*range(30), 201, 202}
    good_rows = qr.keep_good(df)
    assert good_rows.columns == df.columns
    assert {r.doc_id for r in good_rows.collect()} == kept
    assert qr.judge(df.limit(0)).count() == qr.keep_good(df.limit(0)).count() == 0


def test_kept_rows_have_their_own_columns(spark):
    text = " ".join(f"word{k}" for k in range(90))
    docs = spark.createDataFrame([(1, "h", text, 7, "x"), (2, "h", "short", 8, "y")], "doc_id long, source string, text string, n_words int, fails_base string")
    got = qr.keep_good(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "h", text, 7, "x")]


def test_repeated_lines_are_counted_against_the_lines(spark):
    line = " ".join(f"word{k}" for k in range(60))
    few = "\n".join([f"{k} {line}" for k in range(8)] + [f"0 {line}"] * 2)  # 2 of 10 lines
    many = "\n".join([f"{k} {line}" for k in range(4)] + [f"0 {line}"] * 6)  # 6 of 10 lines
    docs = spark.createDataFrame([(1, few), (2, many), (3, None)], "doc_id long, text string")
    got = qr.measure(docs).withColumns(qr.flags()).select("doc_id", "fails_lines").collect()
    assert {tuple(r) for r in got} == {(1, False), (2, True), (3, False)}
