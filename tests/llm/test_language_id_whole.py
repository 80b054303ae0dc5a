import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import language_id as lid


def texts(lang, n, words=30):
    rng = random.Random(lang)
    syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
    return [" ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(words)) for _ in range(n)]


def test_rare_languages_are_learned_however_many_there_are(spark):
    rows = [(t, f"l{k:03}") for k in range(230) for t in texts(k, 2 if k >= 200 else 3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    out = lid.identify(df.withColumn("truth", F.col("lang")), F.lit(True), most_rows=300).collect()
    assert len(out) == len(rows)
    assert sum(r.lang_pred == r.truth for r in out) >= 0.98 * len(out)
    assert len({r.lang_pred for r in out if r.truth >= "l200"}) >= 29


def test_learns_from_whole_texts(spark):
    """The language shows only after 4,000 characters without a letter, or of the other language."""
    head = "12 34 " * 700
    rows = [(head + t, "xa") for t in texts(1, 20, 300)] + [(t, "xb") for t in texts(2, 20, 300)]
    learned = spark.createDataFrame([(*r, False) for r in rows], "text string, lang string, held boolean")
    held = spark.createDataFrame([(t, "xa", True) for t in texts(1, 30)[20:]], learned.schema)
    out = lid.identify(learned.unionByName(held), ~F.col("held")).where("held").collect()
    assert {r.lang_pred for r in out} == {"xa"}


def test_copies_do_not_displace_texts_and_frequencies_are_of_all_rows(spark):
    rows = [(t, "xa") for t in texts(1, 40)] + [(texts(1, 1)[0], "xa")] * 500 + [("12", "xa"), (None, "xa")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert len(lid.sample(df, "lang", "text", F.lit(True), 30, 4000)) == 30
    found, n = lid.frequencies(lid._learnable(df, "lang", "text", F.lit(True)))
    data = [t.encode() for t, _ in rows[:540]]
    counts = lid.counts_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert n == 540 and (found == (counts > 0).sum(axis=0)).all()
