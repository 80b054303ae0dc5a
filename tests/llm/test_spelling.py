"""Spelling variants against all pairs of words, compared letter by letter."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, noise=31):
    found = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, partners = {}, {w: [v for v in words if near(w, v)] for w in words}
    for w, found in partners.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(partners[w]), words[form[w]] if w in form else None) for w, n in words.items())


def vocabulary(seed, size, alphabet, lengths):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        for _ in range(rng.randint(1, 4)):
            words[w] = rng.choice([2, 3, 20, 21, 200, 2000, 30_000])
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]])
    return {w: n for w, n in words.items() if len(w) >= 7}


@pytest.mark.parametrize(("alphabet", "lengths"), [("ab", [7, 8, 9]), ("aàÿz", [7, 8, 12]), ("a", range(7, 40)), ("abcdefgh", [7, 10, 30])])
@pytest.mark.parametrize(("block", "bundle"), [(1 << 18, 1 << 19), (60, 200)])
def test_all_near_words(spark, alphabet, lengths, block, bundle):
    words = vocabulary(7, min(400, 40 if alphabet == "a" else 400) if alphabet != "a" else 20, alphabet, list(lengths))
    frame = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    found = spelling.variants(frame, block_letters=block, bundle_letters=bundle)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == brute(words)


def test_words_of_texts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcéÀ") for _ in range(rng.randint(5, 12))) for _ in range(40)]
    rows = [(None, "abcdefg Abcdefg"), (0, None), (1, ""), (2, "x" * 5000 + " " + "x" * 5000), (3, "Ààààààà×÷ ĀābcdefgĀ abcdefgßı 1abcdefg2")]
    for doc in range(4, 60):
        rows.append((doc, "".join(rng.choice(base) + rng.choice([" ", ", ", "Ω", "-", "\n"]) for _ in range(rng.randint(1, 200)))))
    rows += rows[-3:]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    assert {r.word: r.n for r in spelling.word_counts(frame).collect()} == counted(rows)
    assert {r.word: r.n for r in spelling.word_counts(frame, noise=0).collect()} == counted(rows, 0)
    assert sorted(map(tuple, spelling.group_variants(frame).collect()), key=lambda r: r[0]) == brute(counted(rows))
    assert spelling.group_variants(frame.limit(0)).collect() == []


def test_words_of_one_half(spark):
    """A third and more of the words share all but their last letters; chains of forms are followed to the end."""
    words = {f"commonprefix{a}{b}{c}": 2 for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefgh"}
    words |= {"startword": 2, "startwords": 20, "startwordsx": 200, "startwordsxy": 2000, "startwordsxyz": 20_000, "startwordsxyzz": 200_000}
    found = spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n bigint"), block_letters=500)
    got = sorted(map(tuple, found.collect()), key=lambda r: r[0])
    assert got == brute(words)
    assert dict((r[0], r[2]) for r in got)["startword"] == "startwordsxyzz"


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        lo = rng.integers(0, n + 1, 200)
        hi = np.array([rng.integers(x, n + 1) for x in lo])
        bound = rng.integers(0, n + 1, 200)
        want = [int((values[a:b] < y).sum()) for a, b, y in zip(lo, hi, bound)]
        assert tree.below(lo, hi, bound).tolist() == want
        some = hi > lo
        k = np.array([rng.integers(0, b - a) for a, b in zip(lo[some], hi[some])], np.int64)
        want = [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo[some], hi[some], k)]
        assert tree.smallest(lo[some], hi[some], k).tolist() == want


def test_crc_of_runs():
    data = np.frombuffer(b"abc" + b"y" * 200 + "é".encode(), np.uint8)
    start, end = np.array([0, 3, 203]), np.array([3, 203, 205])
    before = np.array([zlib.crc32(b"1:"), zlib.crc32(b""), zlib.crc32(b"77:")], np.uint32)
    want = [zlib.crc32(data[s:e].tobytes(), int(c)) for s, e, c in zip(start, end, before)]
    assert spelling.run_crcs(data, start, end, before).tolist() == want
