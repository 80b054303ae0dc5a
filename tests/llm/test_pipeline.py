import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from cadenza.llm import byte_bpe
from cadenza.llm.scratch import BATCH_BYTES, bound_batches


def words(rng, n):
    return ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(8)
    clean = {i: " ".join(words(rng, 120)) for i in range(6)}
    item, shared = words(rng, 12), " ".join(words(rng, 20))
    docs = dict(clean)
    docs[10] = " ".join([*clean[1].split()[:-1], "otherwise"])  # near copy of 1
    docs[11] = clean[2]  # its only line is a repetition
    docs[12] = " ".join(words(rng, 60) + item + words(rng, 60))
    docs[13] = "too short"
    docs[14], docs[15] = f"{clean[0][::-1]}\n{shared}", f"{shared}\n{clean[3][::-1]}"
    docs[16] = None
    rows = [(i, t, "en", "a.example", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("item", " ".join(item))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    expected = clean | {14: docs[14], 15: clean[3][::-1]}
    assert sorted(got) == sorted(expected)
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in expected.items():
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables_and_columns_of_the_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns)
        assert out.count() == 0


def test_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(BATCH_BYTES)
    for value, want in (("64m", f"{4 << 20}b"), ("8m", f"{4 << 20}b"), ("1m", "1m")):
        spark.conf.set(BATCH_BYTES, value)
        bound_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == want
    spark.conf.set(BATCH_BYTES, before)
