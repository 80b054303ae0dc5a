"""The plans of large tables on small ones: nothing is broadcast, by the operators' own choice or by Spark's."""

import pytest

from cadenza.llm import line_dedup, minhash_dedup, ngram_join, prefix_trie, quality_rules, spelling, substring_dedup
from tests.llm import test_line_dedup, test_minhash_dedup, test_ngram_join, test_prefix_trie, test_spelling, test_substring_dedup

DOCS = "doc_id bigint, text string"


@pytest.fixture()
def shuffled(spark, monkeypatch):
    for module in (line_dedup, minhash_dedup, ngram_join, prefix_trie, quality_rules, spelling):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, most=0: df)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield spark
    spark.conf.set(name, before)


def test_shuffled_ngram_join(shuffled):
    docs = test_ngram_join.corpus()
    got = ngram_join.join_similar(shuffled.createDataFrame(docs, DOCS).repartition(3), limit=16).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == test_ngram_join.brute(docs)


def test_shuffled_line_dedup(shuffled):
    docs = test_line_dedup.corpus(2)
    got = line_dedup.remove_lines(shuffled.createDataFrame(docs, DOCS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == test_line_dedup.brute(docs, line_dedup.MIN_FUZZY)


def test_shuffled_substring_dedup(shuffled):
    docs = test_substring_dedup.corpus()
    got = substring_dedup.remove_repeats(shuffled.createDataFrame(docs, DOCS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == test_substring_dedup.brute(docs, substring_dedup.WINDOW)


def test_shuffled_quality_rules(shuffled):
    good, symbols = (" ".join(f"{w}{i}" for i in range(80)) for w in ("word", "a#<>$%"))
    docs = [(i, good, "good.example") for i in range(30)] + [(100 + i, symbols, "bad.example") for i in range(30)] + [(200, good, "bad.example"), (201, good, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(shuffled.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got[0] and got[201] and not got[200]


def test_shuffled_minhash_dedup(shuffled):
    rows = test_minhash_dedup.corpus(3)
    found = minhash_dedup.find_copies(shuffled.createDataFrame(rows, DOCS), limit=8)
    assert sorted(map(tuple, found.collect())) == test_minhash_dedup.brute(rows)


def test_shuffled_spelling(shuffled):
    words = test_spelling.vocabulary(9, 300, "abé", [7, 8, 9])
    found = spelling.variants(shuffled.createDataFrame(sorted(words.items()), "word string, n bigint"), block_letters=60, bundle_letters=200)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == test_spelling.brute(words)


def test_shuffled_prefix_trie(shuffled):
    rows = test_prefix_trie.corpus(6)
    found = prefix_trie.trie(shuffled.createDataFrame(rows, test_prefix_trie.SCHEMA).repartition(5), range_bytes=64)
    assert sorted(map(tuple, found.collect()), key=repr) == test_prefix_trie.brute(rows)
