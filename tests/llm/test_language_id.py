import math
import random

from pyspark.sql import functions as F

from cadenza.llm import language_id as lid

SYLLABLES = {"xa": ["ka", "ti", "mu", "ro"], "xb": ["sch", "ein", "ung", "ver"], "xc": ["ção", "lha", "nde", "ím"]}


def corpus(n=240):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80)))
        rows.append((k, text, lang if rng.random() > 0.1 else None, lang))
    return rows


def test_held_out_accuracy_and_undetermined_rows(spark):
    rows = corpus() + [(900, None, "xa", "und"), (901, "12 … !?", "xb", "und"), (902, "", "xc", "und"), (None, "ka ti mu", None, "xa")]
    rows += [rows[0], (903, "ka ti mu ro " * 40000, None, "xa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("score", F.lit("old"))
    held = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    out = lid.identify(df, ~held, per_language=40).collect()
    assert len(out) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in out if r.truth == "und")
    judged = [r for r in out if r.truth != "und"]
    assert sum(r.lang_pred == r.truth for r in judged) >= 0.98 * len(judged)
    assert all(0 <= r.score <= 1 for r in out)


def test_far_texts_are_rejected_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(k, t, g) for k, t, g, _ in corpus()], "doc_id long, text string, lang string")
    model = lid.fit(lid.sample(df, "lang", "text", F.lit(True), 40, 4000, 200, 4000))
    assert sorted(set(model.languages)) == ["xa", "xb", "xc"] and len(model.languages) == 12
    far = spark.createDataFrame([(1, "zzq wwx yyj qqz jjw")], "doc_id long, text string")
    assert lid.predict(far, model).first().rejected
    assert {r.lang_pred for r in lid.identify(df, F.lit(False)).collect()} == {"und"}
    assert lid.identify(df.limit(0), F.lit(True)).count() == 0


def brute_vector(text):
    """Trigram bucket to count, byte by byte."""
    codes = []
    for b in text.encode():
        if 0x41 <= b <= 0x5A:
            b += 32
        codes.append(0x20 if b == 0x20 or 0x09 <= b <= 0x0D or 0x30 <= b <= 0x39 else b)
    codes = [0x20, *codes, 0x20]
    out = {}
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b != 0x20:
            code = ((a << 16 | b << 8 | c) * 0x9E3779B1) % 2**32
            code = ((code ^ code >> 15) * 0x85EBCA77) % 2**32
            out[code >> 19] = out.get(code >> 19, 0) + 1
    return out


def test_predictions_against_brute_force(spark):
    """Dictionaries of trigrams, TF-IDF and the cosine with every centroid, one after the other."""
    train = [(g, t) for _, t, g, _ in corpus(60) if g]
    model = lid.fit(train)
    frequency = {}
    for _, t in train:
        for bucket in brute_vector(t):
            frequency[bucket] = frequency.get(bucket, 0) + 1
    idf = {b: math.log((1 + len(train)) / (1 + n)) + 1 for b, n in frequency.items()}
    missing = math.log(1 + len(train)) + 1
    assert all(abs(model.idf[b] - idf.get(b, missing)) < 1e-5 for b in range(lid.DIMENSIONS))
    texts = [t for _, t, _, _ in corpus(50)] + ["KA ti", "x", "ção 12 schein", "zzz qqq", "a\u00a0b " * 300]
    found = {r.k: r for r in lid.predict(spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3), model).collect()}
    for k, text in enumerate(texts):
        vector = {b: math.log1p(n) * idf.get(b, missing) for b, n in brute_vector(text).items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v / length * float(c[b]) for b, v in vector.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
        near = [i for i, c in enumerate(cosines) if cosines[best] - c < 1e-6]  # float32 may choose among these
        assert found[k].lang_pred in {model.languages[i] for i in near}
        assert abs(found[k].score - min(1.0, max(0.0, cosines[best]))) < 1e-5
        if abs(cosines[best] - model.floor[best]) > 1e-5 and len(near) == 1:
            assert found[k].rejected == (cosines[best] < model.floor[best])


def test_first_of_equal_centroids(spark):
    model = lid.fit([("b", "ka ti mu"), ("a", "ka ti mu"), ("c", "sch ein ung")])
    assert model.languages == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, "ka ti mu"), (2, "ung ein")], "k long, text string")
    assert {r.k: r.lang_pred for r in lid.predict(rows, model).collect()} == {1: "a", 2: "c"}
