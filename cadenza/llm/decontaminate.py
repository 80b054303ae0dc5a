"""Benchmark decontamination by Wu-Manber search over word sequences.

Words are runs of digits, ASCII letters (A-Z in lower case) and non-ASCII characters. A pattern is a window of
10 consecutive words of a benchmark item; an item of fewer words is one pattern. Patterns of one length m share
a table over blocks of two words: the shift says how far the search may jump because no pattern has that block
further right. Where the shift is 0, the bucket of the block gives the patterns that end so, and these are
compared word by word with the text. Cursors of many text segments advance together in NumPy.

The tables of a block of patterns are sent to the tasks; blocks have `block_patterns` patterns at most on average, so what is
broadcast is bounded, and a larger benchmark is searched in several passes, one block after the other, whose hits are
written and then united per document.

Defined cases: null texts and items have no words; repeated items with the same id count once, an item with a
null id marks its hits but is not counted as an item; repeated documents are each judged, empty tables give empty
or clean results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import materialize
from cadenza.llm.tokens import ALNUM, U64, Words, chunks, mix, released

WINDOW = 10
#: Number of a row while several blocks are searched; no input column has this name.
ROW = "_cadenza_decontaminate_row"
#: Words of a text that one cursor searches.
SEGMENT = 512


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as UTF-8."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), ALNUM, lower=True)
    raw = data.tobytes().lower()  # bytes.lower changes A-Z only
    return [raw[a:b] for a, b in zip(w.start, w.end, strict=True)]


def patterns_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], set[str]]:
    """Pattern (words) to the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[i : i + window])] |= {item} if item is not None else set()
    return dict(found)


def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(3) + right, 11)


class Searcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], ids: list[int]):
        self.length = m = len(patterns[0])
        self.patterns, self.ids = patterns, np.array(ids)
        joined = b" ".join(b" ".join(p) for p in patterns)
        data = np.frombuffer(joined, np.uint8)
        self.codes = Words(data, np.array([0, len(data)]), ALNUM, lower=True).hash.reshape(-1, m)
        self.width = min(2, m)
        blocks = self.codes if self.width == 1 else _block(self.codes[:, :-1], self.codes[:, 1:])
        self.bits = max(10, int(2 * len(patterns) * m).bit_length())
        self.shift = np.full(1 << self.bits, m - self.width + 1, np.int32)
        for k in range(blocks.shape[1]):  # the further right a block is, the smaller the shift
            np.minimum.at(self.shift, self._slot(blocks[:, k]), blocks.shape[1] - 1 - k)
        suffix = self._slot(blocks[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> U64(64 - self.bits)).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern number) of every occurrence inside one text."""
        m, codes = self.length, words.hash
        lo, hi = words.first[:-1], words.first[1:]
        n_parts = np.maximum(0, -(-(hi - lo - m + 1) // SEGMENT))
        text = np.repeat(np.arange(len(lo)), n_parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        at = lo[text] + part * SEGMENT + m - 1  # the last word of the window under the cursor
        until = np.minimum(at + SEGMENT, hi[text])
        places, found = [], []
        while len(at):
            slot = self._slot(codes[at] if self.width == 1 else _block(codes[at - 1], codes[at]))
            shift = self.shift[slot]
            stop = np.flatnonzero(shift == 0)
            if len(stop):
                first, counts = self.bucket[slot[stop]], self.bucket[slot[stop] + 1] - self.bucket[slot[stop]]
                place = np.repeat(at[stop] - (m - 1), counts)
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                pattern = self.order[np.repeat(first, counts) + inner]
                same = np.ones(len(place), bool)
                for k in range(m):
                    same[same] = codes[place[same] + k] == self.codes[pattern[same], k]
                places.append(place[same])
                found.append(pattern[same])
            at = at + np.maximum(shift, 1)
            live = at < until
            at, until = at[live], until[live]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, pattern = np.concatenate(places), np.concatenate(found)
        raw = words.data.tobytes().lower() if len(place) else b""
        true = [
            all(raw[words.start[i + k] : words.end[i + k]] == w for k, w in enumerate(self.patterns[p]))
            for i, p in zip(place.tolist(), pattern.tolist(), strict=True)
        ]
        return place[true], pattern[true]


def _searchers(block: list[tuple[tuple[bytes, ...], int]]) -> list[Searcher]:
    by_length = defaultdict(list)
    for pattern, number in block:
        by_length[len(pattern)].append((pattern, number))
    return [Searcher(*map(list, zip(*group, strict=True))) for _, group in sorted(by_length.items())]


def _scan(searchers: list[Searcher], holders: list[list[str]], texts: pa.Array) -> pa.RecordBatch:
    """n_words, runs of hit words (start, end) and hit item ids for every text."""
    n_words, runs, items = [], [], []
    for row, until, data, bounds in chunks(texts):
        words = Words(data, bounds, ALNUM, lower=True)
        n_words.append(words.counts)
        spans, hits = defaultdict(list), defaultdict(set)
        for s in searchers:
            place, pattern = s.find(words)
            text = np.searchsorted(words.first, place, "right") - 1
            for t, i, p in zip(text.tolist(), place.tolist(), pattern.tolist(), strict=True):
                spans[t].append((i - int(words.first[t]), i - int(words.first[t]) + s.length))
                hits[t].update(holders[s.ids[p]])
        for t in range(until - row):
            merged: list[list[int]] = []
            for a, b in sorted(spans.get(t, ())):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            runs.append([x for span in merged for x in span])
            items.append(sorted(hits.get(t, ())))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(n_words) if n_words else np.zeros(0), pa.int64()),
            pa.array(runs, pa.list_(pa.int32())),
            pa.array(items, pa.list_(pa.string())),
        ],
        names=["_n_words", "_hit_runs", "_items"],
    )


def _blocks(benchmark: DataFrame, text: str, item_id: str, window: int, block_patterns: int) -> Iterator[tuple[list[Searcher], list[list[str]]]]:
    """Tables and item ids of one block of the benchmark after the other; the driver holds one block's texts at a time.

    Rows go to blocks by id and text together, so rows of one id, or of none, are not all in one block.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // (2 * block_patterns)))  # a pattern starts at a word, which with its gap has 2 characters or more
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).collect()
        found = patterns_of([(r.item, r.text) for r in block], window)
        yield _searchers([(p, i) for i, p in enumerate(found)]), [sorted(v) for v in found.values()]


def _searched(docs: DataFrame, text: str, rest: list[str], tables: Broadcast) -> DataFrame:
    """The columns `rest` of `docs`, with _n_words, _hit_runs and _items for the patterns of one block (in `tables`)."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", _n_words bigint, _hit_runs array<int>, _items array<string>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, holders = tables.value
        for batch in batches:
            hit = _scan(searchers, holders, batch.column(len(rest)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *hit.columns], names=[*rest, *hit.schema.names])

    return docs.select(*rest, F.col(text).alias("_searched")).mapInArrow(released(scan), schema)


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    block_patterns: int = 200_000,
) -> DataFrame:
    """`docs` without `text`, with n_words, hit_runs (starts and ends, counted in words), items (sorted ids), n_hit,
    n_items, items_sha256 and contaminated. These names replace input columns of the same name."""
    added = ("n_words", "hit_runs", "items", "n_hit", "n_items", "items_sha256", "contaminated")
    blocks = _blocks(benchmark, text if text in benchmark.columns else "text", item_id, window, block_patterns)
    rest = [c for c in docs.columns if c != text and c not in added]
    block, following = next(blocks), next(blocks, None)
    if following is None:
        found = _searched(docs, text, rest, docs.sparkSession.sparkContext.broadcast(block))
    else:
        docs = _numbered(docs.select(*rest, text))
        hits = None
        for block in chain([block, following], blocks):
            some = _hits_of(docs, text, block, every=hits is None)
            hits = some if hits is None else hits.unionByName(some)
        hits = hits.groupBy(ROW, "_n_words").agg(
            _united(F.flatten(F.collect_list("_hit_runs"))).alias("_hit_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items")
        )
        found = docs.select(ROW, *rest).join(hits, ROW).drop(ROW)
    found = found.withColumnsRenamed({"_n_words": "n_words", "_hit_runs": "hit_runs", "_items": "items"})
    return found.withColumns(
        {
            # the runs alternate start, end: x - acc adds up the ends and takes off the starts
            "n_hit": F.aggregate("hit_runs", F.lit(0).cast("bigint"), lambda acc, x: x.cast("bigint") - acc),
            "n_items": F.size("items").cast("bigint"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
            "contaminated": F.size("hit_runs") > 0,
        }
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs`, written with a number (ROW) for every row."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _hits_of(docs: DataFrame, text: str, block: tuple[list[Searcher], list[list[str]]], every: bool) -> DataFrame:
    """What the patterns of one block hit, written, so that the block's tables can go: all rows of `docs`, or only those hit."""
    tables = docs.sparkSession.sparkContext.broadcast(block)
    found = _searched(docs, text, [ROW], tables)
    found = materialize(found if every else found.where(F.size("_hit_runs") > 0), "hits")
    tables.destroy()
    return found


def _united(runs: Column) -> Column:
    """Runs (starts and ends in turn) of one document from several blocks of patterns, made disjoint."""
    pairs = F.transform(F.filter(F.transform(runs, lambda x, i: F.struct(i.alias("i"), x.alias("a"))), lambda x: x["i"] % 2 == 0), lambda x: F.struct(x["a"].alias("a"), F.get(runs, x["i"] + 1).alias("b")))

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(last, x["b"])))
        return F.when((F.size(out) > 0) & (x["a"] <= last), longer).otherwise(F.concat(out, F.array(x["a"], x["b"])))

    return F.aggregate(F.array_sort(pairs), F.array().cast("array<int>"), add)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_patterns: int = 200_000
) -> DataFrame:
    """The rows of `docs` in which no pattern of the benchmark occurs, with the same columns.

    Several blocks are searched one after the other; the numbers of the rows that each hits are written in between.
    """
    columns = docs.columns
    blocks = _blocks(benchmark, text, item_id, window, block_patterns)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _searched(docs, text, columns, docs.sparkSession.sparkContext.broadcast(block)).where(F.size("_hit_runs") == 0).select(*columns)
    docs = _numbered(docs)
    hits = None
    for block in chain([block, following], blocks):
        some = _hits_of(docs, text, block, every=False).select(ROW)
        hits = some if hits is None else hits.unionByName(some)
    return docs.join(hits.distinct(), ROW, "left_anti").select(*columns)
