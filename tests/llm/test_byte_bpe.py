import hashlib
import random

import public_tokenizers
import tiktoken

from cadenza.llm import byte_bpe

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODING = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def corpus():
    rng = random.Random(4)
    letters = "abcdethnors éüñßç的日本語한국😀́  　\n\t\r\x1c'’.,!?0123456789١٢" + "   "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += ["", None, " ", "\n\n  x", "we've they'll I'M", "x" * 300, "the " * 3000, "<|endoftext|>", "\x00\x7f a", "a  \n b　 c"]
    texts += [texts[3], texts[3]]
    return list(enumerate(texts)) + [(None, "no id")]


def test_same_ids_as_the_library_and_round_trip(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "array(1, 2) AS tags", "'c' AS ids")
    got = byte_bpe.encode(df.repartition(3), RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted(((i, ENCODING.encode_ordinary(t or ""), (t or "").encode()) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=str) == expected
    assert all(r.tags == [1, 2] for r in got)


def test_digests_and_small_dictionary(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(byte_bpe, "DICTIONARY", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 2000)
    got = byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in docs:
        ids = ENCODING.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(expected, key=str)
    assert byte_bpe.digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_very_long_words_and_shared_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1025, 3000, 30_000)] + ["a" * 5000, "ab" * 1500, "é" * 2000]
    docs = list(enumerate([*long, *("seldom words wander over shared lines " + x for x in "abcdefgh")]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for most in (byte_bpe.SHARED, 3):
        monkeypatch.setattr(byte_bpe, "SHARED", most)
        got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
        assert got == {i: (ENCODING.encode_ordinary(t), t.encode()) for i, t in docs}
    assert 0 < byte_bpe.common_pieces(df, "text", 1000).count() < 1000


def test_every_pair_is_found_and_no_other():
    pairs = byte_bpe.merge_pairs(RANKS)
    shift, slots = byte_bpe.displaced(pairs)
    rng, seen = random.Random(2), 0
    for left, right in [*pairs, *((rng.randrange(len(shift)), rng.randrange(len(shift))) for _ in range(50_000))]:
        at = shift[left] + right
        rank = slots[at] ^ (left << byte_bpe.ID_BITS) if at < len(slots) and slots[at] is not None else byte_bpe.NO_RANK
        assert min(rank, byte_bpe.NO_RANK) == pairs.get((left, right), byte_bpe.NO_RANK)
        seen += 1
    assert seen == len(pairs) + 50_000
