"""Join of documents whose sets of word shingles have a Jaccard similarity of `similarity` or more: chosen paths.

Words are runs of anything but space and the controls 09 to 0D; a shingle is 5 consecutive words, or all words of a
text that has fewer. Documents with equal sets are one class, found by hash, and only one member of each goes on.

In each of `runs` repetitions a set chooses tokens: those whose hash for the run and level is below a bound that falls
with the size of the set, so that similar sets choose the same ones. Sets that chose the same token share a bucket.
A bucket of more than `limit` sets is split again by the tokens that its sets chose for the next level, up to `levels`
times, so passages that many documents share do not make large buckets. A bucket that would not get smaller (its sets are
alike) or is still large at the last level is compared in tiles of `limit` by `limit` sets: every pair meets in one tile,
none is left out. A pair at the bound shares on average `branch[0]` tokens per run at the first level, and is missed
with a probability of about exp(-runs * branch[0]) there (1.5e-8 as set below).

Buckets are compared in two passes: sketches of 64 hash bins find sets with a plausible partner (a pair at the bound
fails with a probability below 1e-6), and only these sets' tokens are fetched and compared exactly. A pair that meets in
several buckets is counted in the least of them; to the others it brings no set into the second pass. Tasks send back sums and the least member linked to each set, not pairs.

Result: one row per document with `class_id`, the least id of its connected component of links, and `n_links`, the
number of different texts that it is linked with (texts with the same shingles as its own included, itself not).

Defined cases: null and empty texts have no shingles, no links and a class of their own; a null id gives a null class
and no links and takes no part; repeated rows of one id and text count as one text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.llm.scratch import broadcast_if_small, discard, materialize, n_partitions
from cadenza.llm.tokens import U64, Words, chunks, list_array, mix, released, signed

SHINGLE, SIMILARITY = 5, 0.8
RUNS, LEVELS, LIMIT = 12, 3, 1024
#: Sets of a bucket whose sketches are compared in one tile with those of another block.
SKETCHES = 4096
BRANCH = (1.5, 2.0, 2.0)
BINS = 64
#: A bucket is not split if this share of its sets chose a token of the next level that its first set chose: they are alike.
STUCK = 0.5
#: A sketch passes with this share of equal bins, and always if it has fewer filled bins than FEW_BINS.
PASS, FEW_BINS = 0.5, 32
#: A tile's number is its lesser block times TILE plus its greater one.
TILE = 1 << 30
#: Pairs that are looked at together.
PAIRS = 1 << 17
#: The run of a bucket is in its lowest bits.
RUN_BITS = 4


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, sorted within each text and without repeats; number of them per text); `lower`: A-Z count as a-z."""
    words = Words(data, bounds, lower=lower)
    parts = [words.windows(size, 31)]
    text = words.text_of_word()
    tokens, owner = parts[0][0][parts[0][1]], text[: len(parts[0][1])][parts[0][1]]
    for n in range(1, size):  # texts with fewer words are one shingle
        hashes, _ = words.windows(n, 31)
        short = np.flatnonzero(words.counts == n)
        tokens = np.concatenate([tokens, hashes[words.first[short]]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.bincount(owner[new], minlength=len(bounds) - 1)


def _choices(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, level: int, runs: int, similarity: float, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, token with the run in its lowest bits) of the tokens chosen for a level, sorted by text."""
    share = np.minimum(branch / (similarity * np.maximum(sizes, 1)), 1.0)
    bound = np.where(share >= 1, np.float64(2**64 - 2**11), share * 2.0**64).astype(U64)[owner]
    texts, chosen = [], []
    for run in range(runs):
        odd = mix(np.array([level * 1000 + run], U64), 77)[0] | U64(1)
        hit = np.flatnonzero(tokens * odd <= bound)
        texts.append(owner[hit])
        chosen.append(((mix(tokens[hit], 100 + level) >> U64(RUN_BITS)) << U64(RUN_BITS)) | U64(run))
    texts, chosen = np.concatenate(texts), np.concatenate(chosen)
    order = np.argsort(texts, kind="stable")
    return texts[order], chosen[order]


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of BINS bins of hashes 8 bits of its least token, or 0 where it is empty."""
    bins = (tokens >> U64(58)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    out = np.zeros(BINS, np.uint8)
    has = first < len(tokens)
    has[has] = bins[first[has]] == np.flatnonzero(has)
    out[has] = ((mix(tokens[first[has]], 55) >> U64(48)).astype(np.int64) % 255 + 1).astype(np.uint8)
    return out


def _sets(size: int, similarity: float, runs: int, branch: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, until, data, bounds in chunks(batch.column(1)):
                tokens, sizes = shingle_sets(data, bounds, size)
                owner = np.repeat(np.arange(until - row), sizes)
                first = np.concatenate([[0], np.cumsum(sizes)])
                buffer = tokens.tobytes()
                ids, sketches = [], []
                for t in range(until - row):
                    a, b = int(first[t]), int(first[t + 1])
                    ids.append(xxhash.xxh3_64_intdigest(buffer[8 * a : 8 * b]) if b > a else None)
                    sketches.append(_sketch(tokens[a:b]).tobytes() if b > a else None)
                columns = [
                    batch.column(0).slice(row, until - row),
                    pa.array([None if i is None else i - 2**63 for i in ids], pa.int64()),
                    batch.column(2).slice(row, until - row),
                    pa.array(sizes, pa.int32()),
                    pa.array(sketches, pa.binary()),
                ]
                for level, c in enumerate(branch):
                    at, chosen = _choices(tokens, owner, sizes, level, runs, similarity, c)
                    columns.append(list_array(signed(chosen), np.bincount(at, minlength=until - row), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "id", "text", "size", "sketch", *(f"c{k}" for k in range(len(branch)))])

    return run


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (path, id) of buckets with two sets or more, with the number `n` of their sets."""
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(rows.join(counts, "path").select("path", "id", "n"), name)


def buckets(classes: DataFrame, levels: int, limit: int) -> DataFrame:
    """(path, id, n): the buckets to compare, after splitting those over `limit`."""
    found = _counted(classes.select(F.explode("c0").alias("path"), "id").distinct(), "buckets")
    made, leaves = [found], [found.where(F.col("n") <= limit)]
    for level in range(1, levels):
        large = found.where(F.col("n") > limit)
        if large.isEmpty():
            break
        run = F.lit((1 << RUN_BITS) - 1)
        of_run = F.filter("next", lambda t: t.bitwiseAND(run) == F.col("path").bitwiseAND(run))
        large = large.join(classes.select("id", F.col(f"c{level}").alias("next")), "id").select("path", "id", "n", of_run.alias("next"))
        large = materialize(large, "large")
        one = broadcast_if_small(large.groupBy("path").agg(F.min_by("next", "id").alias("one")))
        alike = F.avg(F.arrays_overlap("next", "one").cast("int"))
        stuck = large.join(one, "path").groupBy("path").agg(alike.alias("alike")).where(F.col("alike") >= STUCK).select("path")
        stuck = materialize(stuck, "stuck")
        few = broadcast_if_small(stuck)
        leaves.append(large.join(few, "path", "left_semi").select("path", "id", "n"))
        kids = large.join(few, "path", "left_anti").select("id", F.col("path").alias("parent"), F.explode("next").alias("t"))
        path = F.xxhash64("parent", "t").bitwiseAND(~((1 << RUN_BITS) - 1)).bitwiseOR(F.col("parent").bitwiseAND(run))
        found = _counted(kids.select(path.alias("path"), "id").distinct(), f"buckets-{level}")
        leaves.append(found.where(F.col("n") <= limit))
        made += [large, stuck, found]
    else:
        leaves.append(found.where(F.col("n") > limit))
    out = materialize(reduce(DataFrame.unionByName, leaves), "leaves")
    for table in made:
        discard(table)
    return out


def _tiled(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` with `block` and `tile`: the sets of a bucket over `limit` are dealt into blocks, and a tile has two blocks."""
    blocks = F.ceil(F.col("n") / limit).cast("bigint")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: F.least("block", j) * TILE + F.greatest("block", j))
    return rows.withColumn("tile", F.explode(pairs))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole (path, tile) groups, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        path, tile = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("path", "tile"))
        change = np.flatnonzero((path[1:] != path[:-1]) | (tile[1:] != tile[:-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if held:
            before = held[-1]
            same = before.column(before.schema.names.index("path"))[-1].as_py() == path[0] and before.column(before.schema.names.index("tile"))[-1].as_py() == tile[0]
            if not same:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            elif last:
                held.append(batch.slice(0, int(change[0]) + 1))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, batch, last = [], batch.slice(int(change[0]) + 1), last - int(change[0]) - 1
        if last:
            yield batch.slice(0, last)
        if len(batch) > last:
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _starts(path: np.ndarray, tile: np.ndarray) -> np.ndarray:
    new = np.ones(len(path) + 1, bool)
    new[1:-1] = (path[1:] != path[:-1]) | (tile[1:] != tile[:-1])
    return np.flatnonzero(new)


def _meet(tile: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair belongs to its tile: both blocks are different in a tile of two."""
    two = tile[i] // TILE != tile[i] % TILE
    return ~two | (block[i] != block[j])


def _pair_chunks(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of every group, some PAIRS at a time."""
    sizes = np.diff(starts)
    of_row = np.repeat(starts[1:], sizes) - np.arange(starts[-1]) - 1  # partners after each row
    total = np.concatenate([[0], np.cumsum(of_row)])
    row = 0
    while row < len(of_row):
        until = max(row + 1, int(np.searchsorted(total, total[row] + PAIRS, "right")) - 1)
        count = of_row[row:until]
        i = np.repeat(np.arange(row, until), count)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        row = until


def _met_before(starts: np.ndarray, earlier: pa.ListArray) -> np.ndarray:
    """For every row a bit for each of the 64 earlier buckets that most rows of its group have."""
    out = np.zeros(len(earlier), U64)
    counts = np.asarray(earlier.value_lengths(), np.int64)
    if not counts.sum():
        return out
    row, value = np.repeat(np.arange(len(counts)), counts), earlier.flatten().to_numpy()
    ends = np.searchsorted(row, starts)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        some, n = np.unique(value[a:b], return_counts=True)
        some = np.sort(some[np.argsort(-n, kind="stable")[:64]])
        at = np.searchsorted(some, value[a:b]).clip(max=max(len(some) - 1, 0))
        hit = some[at] == value[a:b] if len(some) else np.zeros(0, bool)
        np.bitwise_or.at(out, row[a:b][hit], U64(1) << at[hit].astype(U64))
    return out


def _plausible(similarity: float):
    """(path, id) of the sets with a plausible partner in their bucket that they do not certainly share an earlier one with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            path, tile, block, size = (batch.column(c).to_numpy() for c in ("path", "tile", "block", "size"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            filled = (sketch > 0).sum(axis=1)
            keep, starts = np.zeros(len(batch), bool), _starts(path, tile)
            before = _met_before(starts, batch.column("earlier"))
            for i, j in _pair_chunks(starts):
                near = _meet(tile, block, i, j) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
                near &= (before[i] & before[j]) == 0
                i, j = i[near], j[near]
                a, b = sketch[i], sketch[j]
                equal, either = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
                good = (equal >= PASS * either) | (np.minimum(filled[i], filled[j]) < FEW_BINS)
                keep[i[good]] = keep[j[good]] = True
            kept = batch.select(["path", "id"]).filter(pa.array(keep))
            if len(kept):
                yield kept

    return run


def _token_rows(size: int):
    """(id, tokens) of the documents asked for, in (doc, text, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2).to_numpy()
            for row, until, data, bounds in chunks(batch.column(1)):
                tokens, sizes = shingle_sets(data, bounds, size)
                first, buffer = np.concatenate([[0], np.cumsum(sizes)]), tokens.tobytes()
                same = [t for t in range(until - row) if sizes[t] and xxhash.xxh3_64_intdigest(buffer[8 * first[t] : 8 * first[t + 1]]) - 2**63 == asked[row + t]]
                rows = [buffer[8 * first[t] : 8 * first[t + 1]] for t in same]
                yield pa.RecordBatch.from_arrays([pa.array(asked[row:until][same], pa.int64()), pa.array(rows, pa.binary())], names=["id", "tokens"])

    return run


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two lists of distinct numbers (a product of incidence matrices)."""
    n = len(lists)
    values, column, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    shared = np.full(len(values), -1)
    often = np.flatnonzero(counts > 1)
    shared[often] = np.arange(len(often))
    place = shared[column]
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, len(often), 2048):
        a, b = np.searchsorted(place, [at, at + 2048])
        matrix = np.zeros((n, min(2048, len(often) - at)), np.float32)
        matrix[row[a:b], place[a:b] - at] = 1
        out += matrix @ matrix.T
    return out


def _links(similarity: float):
    """(doc, id, links, least): of each set the linked texts first met in this bucket, and the least document of its group there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            path, tile, block, texts, doc = (batch.column(c).to_numpy() for c in ("path", "tile", "block", "n_texts", "doc"))
            starts = _starts(path, tile)
            links, least = np.zeros(len(batch), np.int64), doc.copy()
            tokens, leaves = batch.column("tokens"), batch.column("leaves")
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, U64) for x in tokens.slice(a, b - a).to_pylist()]
                sizes = np.array([len(x) for x in sets], np.float64)
                both = _common(sets)
                linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
                np.fill_diagonal(linked, False)
                if tile[a] // TILE != tile[a] % TILE:
                    linked &= block[a:b, None] != block[None, a:b]
                if not linked.any():
                    continue
                earlier = [np.array([p for p in x if p < path[a]], np.int64) for x in leaves.slice(a, b - a).to_pylist()]
                new = linked & (_common(earlier) == 0) if any(map(len, earlier)) else linked
                links[a:b] = new @ texts[a:b]
                label = doc[a:b].copy()
                while True:  # the least document of each connected group, by label propagation
                    best = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (best == label).all():
                        break
                    label = best
                least[a:b] = label
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("id"), pa.array(links), pa.array(least)], names=["doc", "id", "links", "least"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(n_partitions(rows.sparkSession), "path", "tile").sortWithinPartitions("path", "tile")


def _similar(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    runs: int = RUNS,
    levels: int = LEVELS,
    limit: int = LIMIT,
    branch: tuple[float, ...] = BRANCH,
) -> DataFrame:
    """(doc, text, class_id, n_links) for every row of `docs`, `text` being the text's hash."""
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    schema = "doc bigint, id bigint, text bigint, size int, sketch binary" + "".join(f", c{k} array<bigint>" for k in range(levels))
    wide = materialize(named.mapInArrow(released(_sets(size, similarity, runs, branch[:levels])), schema), "sets")
    whole = wide.where("doc IS NOT NULL AND id IS NOT NULL")
    fields = ["doc", "size", "sketch", *(f"c{k}" for k in range(levels))]
    classes = whole.groupBy("id").agg(F.min(F.struct(*fields)).alias("f")).select("id", "f.*")
    n_texts = whole.select("id", "text").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_texts"))
    classes = materialize(classes.join(n_texts, "id"), "classes")
    sets = materialize(wide.select("doc", "id", "text"), "set-ids")
    discard(wide)

    leaves = buckets(classes, levels, limit)
    of_set = leaves.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("path", "n"))).alias("at"))
    rows = of_set.join(classes.select("id", "size", "sketch"), "id").select("id", "size", "sketch", "at", F.explode("at").alias("own"))
    earlier = F.transform(F.filter("at", lambda x: x["path"] < F.col("own.path")), lambda x: x["path"])
    rows = rows.select("own.path", "own.n", "id", "size", "sketch", earlier.alias("earlier"))
    near = _dealt(_tiled(rows, SKETCHES)).mapInArrow(released(_plausible(similarity)), "path bigint, id bigint")
    near = materialize(near.distinct(), "plausible")

    asked = near.select("id").distinct().join(classes.select("id", "doc"), "id")
    tokens = named.drop("key").join(broadcast_if_small(asked, 200_000), "doc").select("doc", "text", "id")
    tokens = materialize(tokens.mapInArrow(released(_token_rows(size)), "id bigint, tokens binary").dropDuplicates(["id"]), "tokens")
    paths = of_set.select("id", F.transform("at", lambda x: x["path"]).alias("leaves"))
    known = tokens.join(paths, "id").join(classes.select("id", "doc", "n_texts"), "id")
    met = near.join(near.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path")
    found = _dealt(_tiled(met.join(known, "id"), limit)).mapInArrow(released(_links(similarity)), "doc bigint, id bigint, links bigint, least bigint")
    found = materialize(found, "links")
    for table in (leaves, near, tokens):
        discard(table)

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("doc").alias("u"), F.col("least").alias("v")))
    groups = groups.withColumnsRenamed({"vertex": "doc", "component": "class_id"})
    verdicts = classes.select("id", "doc", "n_texts").join(links, "id", "left").join(groups, "doc", "left")
    verdicts = verdicts.select(
        "id", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links")
    )
    verdicts = materialize(verdicts, "verdicts")
    alone = F.col("doc").isNull() | F.col("id").isNull()
    out = sets.where(~alone).join(verdicts, "id").select("doc", "text", "class_id", "n_links")
    rest = sets.where(alone).select("doc", "text", F.col("doc").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(rest)


def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of `docs`; `options` are those of the method, as named above."""
    return _similar(docs, doc_id, text, **options).select(F.col("doc").alias(doc_id), "class_id", "n_links")


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """The rows of `docs` without those of another document's class: the one of least id stays.

    A row goes by its own text: other rows of the same id stay if no earlier document holds a near copy of theirs.
    """
    found = _similar(docs, doc_id, text, **options)
    gone = found.where(F.col("class_id") != F.col("doc")).select(F.col("doc").alias("_doc"), F.col("text").alias("_text"))
    gone = broadcast_if_small(materialize(gone.distinct(), "near-copies"), 200_000)
    same = (docs[doc_id].cast("bigint") == gone["_doc"]) & (F.xxhash64(docs[text]) == gone["_text"])
    return docs.join(gone, same, "left_anti")
