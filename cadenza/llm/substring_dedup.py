"""Removal of word windows that an earlier document holds: seed and extend.

Seeds. Of every `window` consecutive words one anchor is chosen, the shingle of `anchor` words with the least hash, the leftmost of
equal ones (winnowing), so equal windows have equal anchors at the same place. A document has a seed where its anchor also
occurs in another document. Within a chunk of texts, equal anchors are reduced to one row before the shuffle, and anchors
known to be shared are spread by document, so no anchor's rows grow with the documents that hold it.

Extension. The earliest document of an anchor gives the words around it, as many to each side as a window can reach, and these
are joined to all other documents of the anchor. There the seed is extended to the left and to the right, word by word, as
far as both agree; windows inside are held by an earlier document. Windows that go on where these words differ can be held by
others that differ alike, or by the earliest document at another place: they are keyed by the anchor's hash and one of all their
words, and the earliest document of each key is an aggregate with map-side partial results. Words are compared by 64-bit hashes.
Overlapping windows join to maximal repeats, and the words they cover are removed. Documents whose whole text
an earlier document has are repeats from end to end and send no windows.

Defined cases: a null text has no words; a document with a null id is neither earlier nor later than another: it
keeps its words and removes none. Rows with the same id are one document for what is earlier, and each is returned.
Texts shorter than the window stay whole. Empty table: empty result. Columns `n_words`, `n_removed`, `removed_runs`,
`kept_sha256`, `kept_text` replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.scratch import materialize
from cadenza.llm.tokens import U64, Words, chunks, list_array, mix, released, signed, sliding_min

WINDOW, ANCHOR = 13, 5


def _windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor hash, hash of all words) of every window inside one text."""
    whole, inside = words.windows(window, 1)
    shingles, _ = words.windows(anchor, 2)
    at = np.flatnonzero(inside)
    chosen = sliding_min(shingles, window - anchor + 1)
    return at, chosen[at], whole[at]


def _offsets(words: Words, at: np.ndarray, chosen: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """How many words of each window come before its anchor."""
    shingles, _ = words.windows(anchor, 2)
    out = np.full(len(at), window - anchor, np.int64)
    for k in range(window - anchor - 1, -1, -1):
        out[shingles[at + k] == chosen] = k
    return out


def _around(words: Words, text: np.ndarray, place: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For every anchor at `place` the hashes of the words to its left, nearest first, and to its right; 0 beyond its text."""
    reach = window - anchor
    steps = np.arange(reach)
    where = np.concatenate([place[:, None] - 1 - steps, place[:, None] + anchor + steps], axis=1)
    inside = (where >= words.first[:-1][text][:, None]) & (where < words.first[1:][text][:, None])
    return np.where(inside, words.hash[np.where(inside, where, 0)], U64(0)) if len(place) else np.zeros((0, 2 * reach), U64)


def _contexts(window: int, anchor: int):
    """(anchor, around) of the anchors in `_own`, of which a document is the earliest holder, where they occur first in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("_own").is_valid())
            own = batch.column("_own")
            for row, until, data, bounds in chunks(batch.column("_text")):
                words = Words(data, bounds)
                at, chosen, _ = _windows(words, window, anchor)
                text = np.searchsorted(words.first, at, "right") - 1
                hit = _member(text, chosen, own, row, until)
                at, chosen, text = at[hit], chosen[hit], text[hit]
                place = at + _offsets(words, at, chosen, window, anchor)
                order = np.lexsort((place, chosen, text))
                new = np.ones(len(order), bool)
                new[1:] = (text[order][1:] != text[order][:-1]) | (chosen[order][1:] != chosen[order][:-1])
                first = order[new]
                around = _around(words, text[first], place[first], window, anchor)
                columns = [pa.array(signed(chosen[first])), pa.array([x.tobytes() for x in around], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "around"])

    return run


def _extended(words: Words, at: np.ndarray, chosen: np.ndarray, text: np.ndarray, entries: pa.ListArray, row: int, until: int, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window with an anchor in `entries`: whether it is found in the words around the anchor there, which are another
    document's; whether it differs from these, or from those that its own document gave (without words: of its first place)."""
    part = entries.slice(row, until - row)
    counts = np.asarray(part.value_lengths().fill_null(0), np.int64)
    values = part.flatten()
    reach, salt = window - anchor, lambda t, k: k ^ mix(t.astype(U64), 5)
    held = differs = np.zeros(len(at), bool)
    if not len(values) or not len(at):
        return held, differs
    keys = salt(np.repeat(np.arange(until - row), counts), values.field(0).to_numpy().view(U64))
    around = np.frombuffer(b"".join(values.field(1).fill_null(bytes(16 * reach)).to_pylist()), U64).reshape(len(values), 2 * reach)
    order = np.argsort(keys)
    keys, around, giver = keys[order], around[order], values.field(2).to_numpy(zero_copy_only=False)[order]
    given = values.field(1).is_valid().to_numpy(zero_copy_only=False)[order]
    own = salt(text, chosen)
    entry = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    known = np.flatnonzero(keys[entry] == own)
    entry, start = entry[known], at[known]
    before = _offsets(words, start, chosen[known], window, anchor)
    place, same, codes = start + before, np.ones(len(known), bool), words.hash
    for k in range(reach):  # one word further to either side, where the window has it
        left, right = same & (k < before), same & (k < reach - before)
        same[left] = codes[place[left] - 1 - k] == around[entry[left], k]
        right &= same
        same[right] = codes[place[right] + anchor + k] == around[entry[right], reach + k]
    held, differs = np.zeros(len(at), bool), np.zeros(len(at), bool)
    first = np.full(len(keys), len(codes))
    np.minimum.at(first, entry, place)
    same = np.where(given[entry], same, place == first[entry])
    held[known], differs[known] = same & ~giver[entry], ~same
    return held, differs


def _unique_pairs(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def _seeds(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, until, data, bounds in chunks(batch.column(1)):
                words = Words(data, bounds)
                at, chosen, _ = _windows(words, window, anchor)
                text = np.searchsorted(words.first, at, "right") - 1
                text, chosen = _unique_pairs(text, chosen)
                doc = ids[row:until].astype(np.int64)[text]
                order = np.lexsort((doc, chosen))
                doc, chosen = doc[order], chosen[order]
                new = np.ones(len(doc), bool)
                new[1:] = chosen[1:] != chosen[:-1]
                group = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
                shared = (doc[first] != doc[last])[group] if len(doc) else np.zeros(0, bool)
                salt = np.where(new | ~shared, 0, doc)  # one row of a shared anchor meets the other chunks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(chosen)), pa.array(salt), pa.array(doc), pa.array(shared)],
                    names=["anchor", "salt", "doc", "shared"],
                )

    return run


def _member(text: np.ndarray, key: np.ndarray, lists: pa.ListArray, row: int, until: int) -> np.ndarray:
    """Whether each (text, key) is in the list of its row."""
    part = lists.slice(row, until - row)
    counts = np.asarray(part.value_lengths().fill_null(0))
    values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    owner = np.repeat(np.arange(until - row), counts)
    salted = lambda t, k: k ^ mix(t.astype(U64), 5)
    return np.isin(salted(text, key), salted(owner, values))


def _keys(window: int, anchor: int):
    """(anchor, whole, doc) of the windows that differ from the words given for their anchor, of each document that is no copy, each once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("_entries").is_valid(), pc.invert(batch.column("_copy"))))
            ids, entries = batch.column("_doc").to_numpy(zero_copy_only=False), batch.column("_entries")
            for row, until, data, bounds in chunks(batch.column("_text")):
                words = Words(data, bounds)
                at, chosen, whole = _windows(words, window, anchor)
                text = np.searchsorted(words.first, at, "right") - 1
                _, hit = _extended(words, at, chosen, text, entries, row, until, window, anchor)
                text, chosen, whole = text[hit], chosen[hit], whole[hit]
                order = np.lexsort((whole, text))
                text, chosen, whole = text[order], chosen[order], whole[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (whole[1:] != whole[:-1]) | (chosen[1:] != chosen[:-1])
                doc = ids[row:until].astype(np.int64)[text[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(chosen[new])), pa.array(signed(whole[new])), pa.array(doc)], names=["anchor", "whole", "doc"]
                )

    return run


def _cut(window: int, anchor: int, with_text: bool):
    """Of (text, entries, first keys, copy): n_words, n_removed, removed_runs, kept_sha256 and maybe the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rest = [c for c in names if c not in ("_doc", "_text", "_entries", "_firsts", "_copy")]
            entries, firsts = batch.column(names.index("_entries")), batch.column(names.index("_firsts"))
            copies = batch.column(names.index("_copy")).to_numpy(zero_copy_only=False).astype(bool)
            n_words, n_removed, runs, n_runs, digests, kept = [], [], [], [], [], []
            for row, until, data, bounds in chunks(batch.column(names.index("_text"))):
                words = Words(data, bounds)
                at, chosen, whole = _windows(words, window, anchor)
                text = np.searchsorted(words.first, at, "right") - 1
                held, differs = _extended(words, at, chosen, text, entries, row, until, window, anchor)
                gone = held | (differs & ~_member(text, whole ^ mix(chosen, 3), firsts, row, until))
                gone |= copies[row:until][text]
                edge = np.zeros(len(words.hash) + 1, np.int32)
                np.add.at(edge, at[gone], 1)
                np.add.at(edge, at[gone] + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                raw = data.tobytes()
                for t in range(until - row):
                    a, b = int(words.first[t]), int(words.first[t + 1])
                    own = raw[bounds[t] : bounds[t + 1]].split()  # on the same six characters
                    removed = covered[a:b]
                    count = int(removed.sum())
                    if count:
                        own = list(compress(own, (~removed).tolist()))
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
                        runs.append(edges)
                        n_runs.append(len(edges))
                    else:
                        n_runs.append(0)
                    left = b" ".join(own)
                    n_words.append(b - a)
                    n_removed.append(count)
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left.decode())
            columns = [*(batch.column(names.index(c)) for c in rest), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            columns += [
                list_array(np.concatenate(runs) if runs else np.zeros(0), np.array(n_runs, np.int64), pa.int32()),
                pa.array(digests, pa.string()),
            ]
            out = [*rest, "_n_words", "_n_removed", "_removed_runs", "_kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
                out.append("_kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=out)

    return run


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False
) -> DataFrame:
    """`docs` without `text`, with n_words, n_removed (long), removed_runs (starts and ends of the maximal repeats, counted
    in words), kept_sha256 and, if asked for, kept_text (the kept words joined by one space)."""
    added = ("n_words", "n_removed", "removed_runs", "kept_sha256", *(["kept_text"] if with_text else []))
    rest = [c for c in docs.columns if c not in (*added, text) or c == doc_id]
    named = docs.select(*rest, F.col(doc_id).cast("bigint").alias("_doc"), F.col(text).alias("_text"))
    texts = named.select("_doc", "_text").where("_doc IS NOT NULL")

    seeds = texts.mapInArrow(released(_seeds(window, anchor)), "anchor bigint, salt bigint, doc bigint, shared boolean")
    near = Window.partitionBy("anchor", "salt").orderBy("doc")
    other = lambda c: F.coalesce(c != F.col("doc"), F.lit(False))
    met = other(F.lag("doc").over(near)) | other(F.lead("doc").over(near))
    seeds = seeds.withColumn("shared", F.col("shared") | met).where("shared")
    same = texts.select("_doc", F.md5(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("digest"))
    same = same.groupBy("digest").agg(F.min("_doc").alias("_doc"))
    firsts_of_text = same.select("_doc").distinct().withColumn("_whole", F.lit(True))

    # copies need no seeds, and anchors that only they share with their first none either
    seeds = seeds.select("anchor", F.col("doc").alias("_doc")).join(firsts_of_text.select("_doc"), "_doc", "left_semi")
    seeds = materialize(seeds.select("anchor", F.col("_doc").alias("doc")), "seeds")
    earliest = seeds.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    most = max(1000, seeds.count() // 1000)  # so at most a thousand anchors have more holders; these are met by broadcasts
    common = F.broadcast(earliest.where(F.col("n") > most).select("anchor", F.col("first").alias("_first")))
    rare = earliest.where(F.col("n") <= most)
    own = earliest.groupBy(F.col("first").alias("_doc")).agg(F.collect_list("anchor").alias("_own"))
    # all readers of the texts take all columns and rows, so that the texts are shuffled once
    contexts = named.join(own, "_doc", "left").mapInArrow(released(_contexts(window, anchor)), "anchor bigint, around binary")
    contexts = contexts.groupBy("anchor").agg(F.min("around").alias("around"), F.count(F.lit(1)).alias("rows"))  # of several rows of the earliest id one counts
    marked = seeds.join(common, "anchor", "left")
    parts = [
        marked.where("_first IS NOT NULL").select("anchor", "doc", F.col("_first").alias("first")).join(F.broadcast(contexts.join(common, "anchor", "left_semi")), "anchor"),
        marked.where("_first IS NULL").select("anchor", "doc").join(rare.select("anchor", "first"), "anchor").join(contexts, "anchor"),
    ]
    giver = F.col("doc") == F.col("first")
    words = F.when(~giver | (F.col("rows") > 1), F.col("around")).alias("around")  # who gave them has them
    entries = parts[0].select("doc", "anchor", words, giver.alias("giver")).unionByName(parts[1].select("doc", "anchor", words, giver.alias("giver")))
    entries = entries.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("anchor", "around", "giver")).alias("_entries"))

    joined = named.join(entries, "_doc", "left").join(firsts_of_text, "_doc", "left")
    joined = joined.withColumn("_copy", F.col("_whole").isNull() & F.col("_doc").isNotNull()).drop("_whole")

    keys = joined.mapInArrow(released(_keys(window, anchor)), "anchor bigint, whole bigint, doc bigint")
    earliest = keys.groupBy("anchor", "whole").agg(F.min("doc").alias("_doc"))
    firsts = earliest.mapInArrow(released(_folded), "_doc bigint, key bigint").groupBy("_doc").agg(F.collect_list("key").alias("_firsts"))

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in rest) + "_n_words bigint, _n_removed bigint, _removed_runs array<int>, _kept_sha256 string"
    whole = joined.join(firsts, "_doc", "left").select(*rest, "_doc", "_text", "_entries", "_firsts", "_copy")
    out = whole.mapInArrow(released(_cut(window, anchor, with_text)), schema + ", _kept_text string" * with_text)
    return out.withColumnsRenamed({f"_{c}": c for c in added})


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key): the two hashes of a window as one, for the list of a document."""
    for batch in batches:
        chosen, whole = (batch.column(i).to_numpy().view(U64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(signed(whole ^ mix(chosen, 3)))], names=["_doc", "key"])
