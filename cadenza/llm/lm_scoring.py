"""Cross-entropy difference of two matched bigram models.

Both models are of the same order and smoothing over one vocabulary: the start and every word of all documents. The target
model counts the documents marked as targets. The background model counts a sample of the others of about the same number of
documents: those whose id's hash is below the share that makes it so (all others if they are fewer). The score of a document is its loss
per word under the target model minus that under the background model (nats; low: like the target). A document that is in a
model is scored without its own counts there, so no score rests on words that the model has from the document itself.

Smoothing: p(w|u) = (c(u,w) + k p(w)) / (c(u) + k) with p(w) = (c(w) + 1) / (n + size).

Neither words nor pairs are bounded in number, and no model is built in one place. Texts are turned into chunks of about
`CHUNK_TOKENS` words, kept in the shared folder; only ids are joined with the targets. Every chunk sends each of its
distinct words and pairs once, with their counts, to the parts that the keys' hashes say; a part sums the counts over all
chunks and sends the sums back in the same order. So a frequent key adds at most one entry a chunk to a part, the number of
parts grows with the input, and a chunk sends no more rows than it has keys. Words and pairs are told apart by 64-bit hashes.

Defined cases: a document without words (null, empty) has n_tokens 0 and null losses; repeated rows count and are scored
as often as they occur, each without its own counts; a document is a target if any of its label rows says so, and one with a
null id is in neither model; with no targets both models are uniform. Other columns do not pass. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import materialize, n_partitions
from cadenza.llm.tokens import U64, Words, chunks, mix, signed

CHUNK_TOKENS, CHUNK_ROWS = 1 << 20, 1 << 17
#: Bytes of text for every part of the key space.
PART_BYTES = 8 << 20


def pack(x: np.ndarray) -> bytes:
    """The numbers of `x`, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unpack(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class Chunk:
    """Distinct words and pairs of a chunk: `number` and `pair` of every word, `before` and `after` of every pair."""

    def __init__(self, table: pa.Table):
        get = lambda name, kind: unpack(table.column(name)[0].as_py(), kind)
        self.lengths, self.number = get("lengths", np.int32).astype(np.int64), get("numbers", np.int32).astype(np.int64)
        words = get("words", U64)
        ends = np.cumsum(self.lengths)
        self.last = (ends - 1)[self.lengths > 0]
        before = np.zeros(len(self.number), np.int64)
        before[1:] = self.number[:-1] + 1
        before[(ends - self.lengths)[self.lengths > 0]] = 0
        base = max(1, len(words))
        pairs, self.pair, self.pair_counts = np.unique(before * base + self.number, return_inverse=True, return_counts=True)
        self.before, self.after = pairs // base, pairs % base
        hashes = np.concatenate([np.zeros(1, U64), mix(words, 3)])
        #: of words and of pairs: the key of each, and their order by it
        self.keys = mix(words, 11), mix(hashes[self.before] + words[self.after], 5)
        self.orders = [np.argsort(keys) for keys in self.keys]

    def counts(self, models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each model (whether it has each document): of words all and those at the end; of pairs. A row for each."""
        n, last = len(self.keys[0]), self.number[self.last]
        tokens = [np.repeat(m, self.lengths) for m in models]
        of_word = [self.number[t] for t in tokens] + [last[m[self.lengths > 0]] for m in models]
        of_pair = [np.bincount(self.pair[t], minlength=len(self.pair_counts)) for t in tokens]
        return np.stack([np.bincount(x, minlength=n) for x in of_word]).astype(np.int32), np.stack(of_pair).astype(np.int32)


WIDTHS = {"word": 4, "pair": 2}


def _chunked():
    """Rows (id, text) to chunks."""

    def chunk(serial: int, ids: list[pa.Array], lengths: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        words, numbers = np.unique(hashes, return_inverse=True)
        listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        raw = [pa.array([pack(x)], pa.binary()) for x in (lengths.astype(np.int32), words, numbers.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), listed, *raw], names=["chunk", "ids", "lengths", "words", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, n_tokens, n_rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, lengths, hashes = zip(*held, strict=True)
            return chunk(serial, list(ids), np.concatenate(lengths), np.concatenate(hashes))

        for batch in batches:
            for row, until, data, bounds in chunks(batch.column(1)):
                w = Words(data, bounds)
                held.append((batch.column(0).slice(row, until - row), w.counts, w.hash))
                n_tokens, n_rows = n_tokens + len(w.hash), n_rows + until - row
                if n_tokens >= CHUNK_TOKENS or n_rows >= CHUNK_ROWS:
                    yield flush()
                    serial, held, n_tokens, n_rows = serial + 1, [], 0, 0
        if held:
            yield flush()

    return run


def _asked(n_parts: int):
    """The distinct words and pairs of a chunk with their counts, by part: a range of keys."""
    edges = np.array([-(-(p << 64) // n_parts) for p in range(1, n_parts)], U64)

    def run(held: pa.Table) -> pa.Table:
        c = Chunk(held)
        columns, some = [], np.zeros(n_parts, bool)
        for keys, order, counts in zip(c.keys, c.orders, c.counts(_models(held, len(c.lengths))), strict=True):
            keys, counts = keys[order], counts[:, order]
            bounds = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            columns += [[pack(keys[a:b]) for a, b in spans], [pack(counts[:, a:b]) for a, b in spans]]
            some |= np.diff(bounds) > 0
        parts = np.flatnonzero(some)
        own = [pa.array([held.column("chunk")[0].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.int32())]
        raw = [pa.array([column[p] for p in parts.tolist()], pa.binary()) for column in columns]
        return pa.table([*own, *raw], names=["chunk", "part", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """The sums over all chunks, for every chunk in the order of its keys.

    `told`, in one row of the part: its number of words, and the sums of their counts.
    """
    columns, told = [], []
    for name, width in WIDTHS.items():
        keys = [unpack(x, U64) for x in asked.column(f"{name}s").to_pylist()]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((width, len(unique)), np.int64)
        ends = np.cumsum([len(x) for x in keys]).tolist()
        spans = list(zip([0, *ends], ends, strict=False))
        for (a, b), raw in zip(spans, asked.column(f"{name}_counts").to_pylist(), strict=True):
            sums[:, at[a:b]] += unpack(raw, np.int32).reshape(width, -1)  # a chunk has each key once
        columns.append(pa.array([pack(sums[:, at[a:b]]) for a, b in spans], pa.binary()))
        told = told or [len(unique), *sums.sum(axis=1).tolist()]
    told = pa.array([told] + [None] * (asked.num_rows - 1), pa.list_(pa.int64()))
    return pa.table([asked.column("chunk"), asked.column("part"), *columns, told], names=["chunk", "part", "word_sums", "pair_sums", "told"])


def _models(held: pa.Table, n: int) -> list[np.ndarray]:
    """Whether each document of a chunk is in the background model and in the target model."""
    out = []
    for name in ("background", "target"):
        member = np.zeros(n, bool)
        member[np.array(held.column(name)[0].as_py() or [], np.int64)] = True
        out.append(member)
    return out


def _own(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every row how many rows have its owner and key."""
    base = int(key.max(initial=0)) + 1
    _, at, counts = np.unique(owner * base + key, return_inverse=True, return_counts=True)
    return counts[at]


def _losses(c: Chunk, member: np.ndarray, words: np.ndarray, last: np.ndarray, pairs: np.ndarray, n: int, starts: int, size: int, k: float) -> np.ndarray:
    """The sum of -log p(w|u) over the words of every document of a chunk; members are scored without their own counts."""
    owner = np.repeat(np.arange(len(c.lengths)), c.lengths)
    inside = member[owner].astype(np.int64)
    before, after = c.before[c.pair], c.after[c.pair]
    left = np.concatenate([[starts], words - last])[before]
    own_pairs, own_words, own_left = _own(owner, c.pair), _own(owner, c.number), _own(owner, before)
    p = (words[after] - inside * own_words + 1) / (n - inside * c.lengths[owner] + size)
    seen = pairs[c.pair] - inside * own_pairs
    return np.bincount(owner, -np.log((seen + k * p) / (left - inside * own_left + k)), len(c.lengths))


#: Steps of the hash that chooses the background.
STEPS = 1 << 30


def score(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", k: float = 50.0) -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score). `targets`: a column `doc_id`, any number of rows for one."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    schema = f"chunk bigint, ids array<{kind}>, lengths binary, words binary, numbers binary"
    held = materialize(docs.select(doc_id, text).mapInArrow(_chunked(), schema), "chunks")
    marks = targets.select(F.col(doc_id).alias("_id")).distinct().withColumn("_target", F.lit(True))
    rows = held.select("chunk", F.posexplode("ids").alias("row", "_id")).where("_id IS NOT NULL")
    # one plan at every size: few labels would be broadcast, many shuffled
    rows = materialize(rows.join(marks.hint("merge"), "_id", "left").withColumn("_target", F.col("_target").isNotNull()), "members")
    n_targets, n_others = rows.agg(F.count(F.when(F.col("_target"), 1)), F.count(F.when(~F.col("_target"), 1))).first()
    share = int(STEPS * min(1.0, n_targets / max(1, n_others)))
    background = ~F.col("_target") & (F.pmod(F.xxhash64("_id"), F.lit(STEPS)) < share)
    rows = rows.groupBy(F.col("chunk").alias("_of")).agg(F.collect_list(F.when(background, F.col("row"))).alias("background"), F.collect_list(F.when(F.col("_target"), F.col("row"))).alias("target"))
    held = held.join(rows.hint("merge"), held["chunk"] == rows["_of"], "left").drop("_of")
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_parts = max(n_partitions(spark), -(-n_bytes // PART_BYTES))
    asked = "chunk bigint, part int, words binary, word_counts binary, pairs binary, pair_counts binary"
    asked = held.drop("ids").groupBy("chunk").applyInArrow(_asked(n_parts), asked)
    answers = "chunk bigint, part int, word_sums binary, pair_sums binary, told array<bigint>"
    answers = materialize(asked.groupBy("part").applyInArrow(_answered, answers), "counts")
    told = answers.where("told IS NOT NULL").agg(*(F.coalesce(F.sum(F.col("told")[i]), F.lit(0)) for i in range(5))).first()
    size = 1 + told[0]

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        c, answers = Chunk(held), answers.sort_by("part")
        sums = []
        for (name, width), order in zip(WIDTHS.items(), c.orders, strict=True):
            own = np.zeros((width, len(order)), np.int64)
            back = [unpack(x, np.int64).reshape(width, -1) for x in answers.column(f"{name}_sums").to_pylist()]
            own[:, order] = np.concatenate([np.zeros((width, 0), np.int64), *back], axis=1)
            sums += list(own)
        members, ce = _models(held, len(c.lengths)), []
        for at in (1, 0):  # of `sums` and `told`: target, background
            losses = _losses(c, members[at], sums[at], sums[2 + at], sums[4 + at], told[1 + at], told[3 + at], size, k)
            ce.append(losses / np.maximum(c.lengths, 1))
        none = c.lengths == 0
        ids = held.column("ids").combine_chunks().flatten()
        values = [pa.array(v, pa.float64(), mask=none) for v in (ce[0], ce[1], ce[0] - ce[1])]
        return pa.table([ids, pa.array(c.lengths, pa.int64()), *values], names=["_id", "n_tokens", "ce_target", "ce_background", "score"])

    schema = f"_id {kind}, n_tokens bigint, ce_target double, ce_background double, score double"
    scored = held.groupBy("chunk").cogroup(answers.drop("told").groupBy("chunk")).applyInArrow(run, schema)
    return scored.withColumnRenamed("_id", doc_id)
