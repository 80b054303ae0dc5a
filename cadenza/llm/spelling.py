"""Spelling variants of one word: two-dimensional range reporting over prefixes and suffixes with wavelet trees.

Words are maximal runs of the letters A to Z, a to z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, with at least
`min_length` letters and `min_count` occurrences. With `noise` (31; 0 for none) a run whose CRC-32 h of `<doc_id>:<run>` is divisible by it loses the
letter h mod length first. Two words are near if one inserted, deleted or replaced letter makes one the other. The form of a
word is its near word of most occurrences (ties: the first in code-point order), if these are at least `factor` times its
own; its root is found by following forms to the end.

1. Tasks count the words of a few megabytes of text, Spark adds the counts up.
2. A word v with m letters is edited at one position of [0, m). Words that differ from v there agree on all else, so they
   meet in a block of words that agree outside a segment [a, b) of positions: first the two halves, and blocks of too
   many letters are split into halves of their segment again, until they fit; a segment of one position cannot have more words than
   letters exist, so this ends, and no block is capped. A word asks in the blocks of its own length for replaced letters and in those of
   words with one letter more for inserted ones; that answer holds for both words.
3. In a block each word is a point: its rank in the forward order and its rank in the order of the reversed words. For
   every edit position the words with the same prefix before it are an interval of the forward order, and those with the
   same suffix after it one of the reverse order. The points in both are the near words; a wavelet tree over the points
   counts and reports them. Tasks send back the number and the best of each word's near words, not pairs.
4. Forms lead to words of ten times the occurrences, so chains are short; they are shortened by half in every round.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count again; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import broadcast_if_small, discard, materialize, n_partitions
from cadenza.llm.tokens import LOWER, chunks, released

MIN_LENGTH, MIN_COUNT, FACTOR, NOISE = 7, 2, 10, 31
#: Letters (words times their length) from which a block is split.
BLOCK_LETTERS = 1 << 18
#: Letters of the blocks that are searched together.
BUNDLE_LETTERS = 1 << 19
TEXT_BYTES = 4_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True  # C3 begins the two bytes of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of letters, none over two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    inside[2:-1] |= data[:-1] == 0xC3
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts], last[cuts - 1] = inside[1:-1][cuts], inside[1:-1][cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of every run of bytes, going on from the CRC in `before`."""
    crc, size = ~before, end - start
    order = np.argsort(-size, kind="stable")
    count = len(size) - np.cumsum(np.bincount(np.minimum(size, 65), minlength=66))  # runs with more than i bytes
    for i in range(64):
        rows = order[: count[i]]
        if not len(rows):
            break
        state = crc[rows]
        crc[rows] = _CRC[(state ^ data[start[rows] + i]) & 0xFF] ^ (state >> np.uint32(8))
    crc = ~crc
    for row in order[: count[64]]:
        crc[row] = zlib.crc32(data[start[row] : end[row]].tobytes(), int(before[row]))
    return crc


def _counted(words: pa.Array) -> pa.RecordBatch:
    found = words.value_counts()
    return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])


def _word_counts(min_length: int, noise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, until, data, bounds in chunks(batch.column(1), TEXT_BYTES):
                data = LOWER[data]
                start, end = letter_runs(data, bounds)
                if not len(start):
                    continue
                wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
                letters = end - start - (wide[end] - wide[start])
                hit = np.zeros(len(start), bool)
                if noise:
                    heads = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids.slice(row, until - row).to_pylist()], np.uint32)
                    crc = run_crcs(data, start, end, heads[np.searchsorted(bounds, start, "right") - 1])
                    hit = (crc % np.uint32(noise) == 0) & (letters > min_length)
                    changed = []
                    for s, e, h in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), strict=True):
                        word = data[s:e].tobytes().decode()
                        at = h % len(word)
                        changed.append(word[:at] + word[at + 1 :])
                    if changed:
                        yield _counted(pa.array(changed, pa.string()))
                    hit |= crc % np.uint32(noise) == 0
                keep = ~hit & (letters >= min_length)
                start, size = start[keep], (end - start)[keep]
                offsets = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
                text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at]))
                yield _counted(text.cast(pa.string()))

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): the words and their occurrences."""
    named = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).cast("string").alias("text"))
    counts = named.mapInArrow(released(_word_counts(min_length, noise)), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _block(a: Column, b: Column, asks: Column) -> Column:
    """The key of the block of words with `m` letters that agree outside [a, b) with the word; it has one letter less if it `asks`."""
    head, tail = F.substring("word", F.lit(1), a), F.substring("word", b - asks + 1, F.lit(2**31 - 1))
    return F.xxhash64("m", a, b, head, F.octet_length(head), tail)


def _split(rows: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(word, n, m, asks, a, b, block) in tables: every word in the blocks it belongs to or asks in, none of more than `limit` letters
    if it can be split; and all tables that were written."""
    half = F.floor(F.col("m") / 2).cast("int")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b"))))
    now = rows.select("*", ends.alias("e")).select("word", "n", "m", "asks", "e.a", "e.b")
    out, made = [], []
    while True:
        now = materialize(now.withColumn("block", _block(F.col("a"), F.col("b"), F.col("asks"))), "blocks")
        made.append(now)
        large = now.groupBy("block").agg(F.sum("m").alias("letters"), F.max(F.col("b") - F.col("a")).alias("width"))
        large = materialize(large.where((F.col("letters") > limit) & (F.col("width") > 1)).select("block"), "large")
        made.append(large)
        if large.isEmpty():
            out.append(now)
            return out, made
        few = broadcast_if_small(large)
        out.append(now.join(few, "block", "left_anti"))
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        ends = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b")))
        now = now.join(few, "block", "left_semi").select("word", "n", "m", "asks", ends.alias("e")).select("word", "n", "m", "asks", "e.a", "e.b")


class WaveletTree:
    """A sequence of numbers below its length, bit by bit from the highest: counts and order statistics of its parts, for many questions at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros, self.ranks = [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            rank = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(int(rank[-1]))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are less than `bound`."""
        count = np.zeros(len(lo), np.int64)
        for level, (rank, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            a, b = rank[lo], rank[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in values[lo:hi]."""
        value = np.zeros(len(lo), np.int64)
        for level, (rank, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            a, b = rank[lo], rank[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return value


class _Order:
    """Words in the order of (block, letters), and for each prefix length the interval of those that agree on it."""

    def __init__(self, letters: np.ndarray, size: np.ndarray, block: np.ndarray, data: np.ndarray):
        width = letters.shape[1]
        order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").reshape(-1), kind="stable")
        order = order[np.argsort(block[order], kind="stable")]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.data_before = np.concatenate([[0], np.cumsum(data[order])])
        self.data_rows = order[data[order]]
        now, before = letters[order[1:]], letters[order[:-1]]
        same = np.where((now != before).any(axis=1), (now != before).argmax(axis=1), width)
        same = np.minimum(same, np.minimum(size[order[1:]], size[order[:-1]]))
        self.same = np.concatenate([[-1], np.where(block[order[1:]] == block[order[:-1]], same, -1)])

    def intervals(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(from, until) in ranks of data words, by [prefix length, place]."""
        n, at = len(self.same), np.arange(len(self.same))
        lo, hi = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        for length in range(longest + 1):
            cut = self.same < length
            first = np.maximum.accumulate(np.where(cut, at, 0))
            starts = np.flatnonzero(cut)
            lo[length] = self.data_before[first]
            hi[length] = self.data_before[np.append(starts[1:], n)[np.cumsum(cut) - 1]]
        return lo, hi


def near_words(words: list[bytes], n: np.ndarray, m: np.ndarray, asks: np.ndarray, a: np.ndarray, b: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of near words found for each row, row of the best of them or -1), of blocks in one array."""
    size = np.array([len(w) for w in words])
    width = int(m.max())
    letters = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
    at = size[:, None] - 1 - np.arange(width)[None, :]
    backward = np.where(at >= 0, np.take_along_axis(letters, np.maximum(at, 0), axis=1), 0).astype(np.uint8)
    data = ~asks
    forward, reverse = _Order(letters, size, block, data), _Order(backward, size, block, data)
    if not data.any():
        return np.zeros(len(words), np.int64), np.full(len(words), -1)
    rank = np.empty(len(words), np.int64)
    rank[reverse.data_rows] = np.arange(len(reverse.data_rows))
    tree = WaveletTree(rank[forward.data_rows])
    row = np.repeat(np.arange(len(words)), b - a)
    position = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]
    suffix = m[row] - 1 - position
    lo, hi = forward.intervals(width)
    x0, x1 = lo[position, forward.place[row]], hi[position, forward.place[row]]
    lo, hi = reverse.intervals(width)
    y0, y1 = lo[suffix, reverse.place[row]], hi[suffix, reverse.place[row]]
    some = np.flatnonzero((x1 - x0 > data[row]) & (y1 - y0 > data[row]))
    row, position, x0, x1, y0, y1 = (x[some].astype(np.int64) for x in (row, position, x0, x1, y0, y1))
    skip = tree.below(x0, x1, y0)
    count = tree.below(x0, x1, y1) - skip
    some = np.flatnonzero(count > data[row])
    row, position, x0, x1, skip, count = (x[some] for x in (row, position, x0, x1, skip, count))
    each = np.repeat(np.arange(len(row)), count)
    k = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + skip[each]
    other = reverse.data_rows[tree.smallest(x0[each], x1[each], k)]
    row, position = row[each], position[each]
    after = np.where(position + 1 < m[row], letters[other, np.minimum(position + 1, width - 1)], 0)
    good = np.where(asks[row], letters[other, position] != after, other != row)  # a letter inserted in a run of its kind counts at the run's end
    row, other = row[good], other[good]
    longer = asks[row]
    row, other = np.concatenate([row, other[longer]]), np.concatenate([other, row[longer]])
    order = np.lexsort((np.array(words), -n))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, row, place[other])
    return np.bincount(row, minlength=len(words)), np.append(order, -1)[best]


def _near(bundle: int):
    """(word, n_near, near_n, near) of rows (word, n, m, asks, a, b, block) in the order of blocks."""

    def search(rows: pa.Table) -> pa.RecordBatch:
        words = rows.column("word").to_pylist()
        n, m, asks, a, b, block = (rows.column(c).to_numpy() for c in ("n", "m", "asks", "a", "b", "block"))
        found, best = near_words([w.encode("latin-1") for w in words], n, m, asks.astype(bool), a, b, block)
        has = np.flatnonzero(found)
        near = [words[i] for i in best[has]]
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in has], pa.string()), pa.array(found[has], pa.int64()), pa.array(n[best[has]], pa.int64()), pa.array(near, pa.string())], names=["word", "n_near", "near_n", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for batch in batches:
            block, m = batch.column("block").to_numpy(), batch.column("m").to_numpy()
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            total = np.append(0, np.cumsum(m))
            done = 0
            for at in starts.tolist():
                goes_on = at == 0 and held and held[-1].column("block")[-1].as_py() == block[0]
                if letters + total[at] - total[done] > bundle and not goes_on:
                    held.append(batch.slice(done, at - done))
                    yield search(pa.Table.from_batches(held))
                    held, letters, done = [], 0, at
            held.append(batch.slice(done))
            letters += int(total[-1] - total[done])
        if held and letters:
            yield search(pa.Table.from_batches(held))

    return run


def variants(vocabulary: DataFrame, factor: int = FACTOR, block_letters: int = BLOCK_LETTERS, bundle_letters: int = BUNDLE_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of `vocabulary` (word, n)."""
    spark = vocabulary.sparkSession
    vocabulary = materialize(vocabulary, "vocabulary")
    size = F.char_length("word")
    roles = F.explode(F.array(F.struct(size.alias("m"), F.lit(0).alias("asks")), F.struct((size + 1).alias("m"), F.lit(1).alias("asks"))))
    tables, made = _split(vocabulary.select("word", "n", roles.alias("r")).select("word", "n", "r.m", "r.asks"), block_letters)
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    rows = rows.repartition(n_partitions(spark), "block").sortWithinPartitions("block")
    found = rows.mapInArrow(released(_near(bundle_letters)), "word string, n_near bigint, near_n bigint, near string")
    best = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))
    own = vocabulary.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("near_n"), F.lit(None).cast("string").alias("near"))
    both = own.unionByName(found.withColumn("n", F.lit(None).cast("bigint")))
    words = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    has = -F.col("best.less") >= factor * F.col("n")
    words = words.select("word", F.when(has, F.col("best.near")).alias("form"), "n", "n_near", F.when(has, -F.col("best.less")).alias("form_n"))
    words = materialize(words, "forms")
    for table in [*made, vocabulary]:
        discard(table)
    return words.select("word", "form").transform(_roots, words)


def _roots(links: DataFrame, words: DataFrame) -> DataFrame:
    """`words` with the root of each: chains of forms, shortened by half in every round."""
    links = links.where("form IS NOT NULL")
    chain = links.join(links.select(F.col("form").alias("word")).distinct(), "word", "left_semi").select("word", F.col("form").alias("root"))
    chain = materialize(chain, "chain")
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = chain.join(broadcast_if_small(further), "root", "left")
        longer = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        discard(chain)
        chain = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    ends = broadcast_if_small(chain.select(F.col("word").alias("form"), "root"))
    return words.join(ends, "form", "left").select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `docs`; `options` are those of `word_counts`."""
    return variants(word_counts(docs, doc_id, text, **options))
