"""Near-copies of documents by b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm.

Words are runs of anything but space and the controls 09 to 0D, A-Z lower-cased; a document's set has its distinct
shingles of 5 words, or all its words as one if it has fewer. Documents are linked if the Jaccard similarity of their
sets is `similarity` (0.85) or more; a component is what links connect.

1. Each set gets `bands * rows` minima of its shingles' hashes. The full minima are hashed band by band; of each
   minimum only two low bits are kept, as two bit planes packed in 64-bit words. Equal sets are one class from here on
   (by a 128-bit hash), and only one row of each class goes on.
2. A bucket holds the classes with one band's key. Two linked sets share none of the bands with a probability of at most
   (1 - 0.85 ** rows) ** bands, 2.6e-7 as set below.
3. The first and the last class of a bucket are compared with all others of it. The count of differing bits estimates
   the similarity, corrected for the quarter of low bits that agree by chance; a pair that is six standard deviations
   below the bound is dropped, every other pair is confirmed on the full sets. One class of many partners is dealt out in
   parts, and its set is held while theirs stream by, so no group is gathered.
4. Only buckets in which these links leave more than one component (and which have over three classes) are compared as
   wholes, in tiles of `limit` by `limit` classes: pairs of different components are estimated in their first common
   bucket, and the sets with a plausible partner are compared exactly. Tasks send back one link for each set, not pairs.
   So a group of near-copies costs its size twice over, and no cap or sample loses a link.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; a null id has a null
component, takes no part and is kept; rows of one id are judged by their own texts; an empty table gives no rows; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.llm.ngram_join import TILE, _common, _groups, _meet, _pair_chunks, _starts, _tiled, shingle_sets
from cadenza.llm.scratch import broadcast_if_small, discard, materialize, n_partitions
from cadenza.llm.tokens import U64, chunks, list_array, mix, released, signed

SHINGLE, SIMILARITY = 5, 0.85
BANDS, ROWS = 32, 6
LIMIT = 512
#: Low bits kept of every minimum, and the share of them that agree by chance.
BITS, CHANCE = 2, 0.25
#: Standard deviations below the bound at which an estimate rules a pair out.
DEVIATIONS = 6.0
#: A class with more partners than this, and more than a thousandth of all pairs, is dealt out in parts.
PART = 256


def least_estimate(similarity: float, minima: int) -> float:
    """The estimate below which a pair is taken to be less similar than `similarity`."""
    agree = similarity + (1 - similarity) * CHANCE
    return similarity - DEVIATIONS * sqrt(agree * (1 - agree) / minima) / (1 - CHANCE)


def signatures(tokens: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of every set that is not empty, one row of each per set.

    The packed words are the planes of the first and the second low bit, one after the other.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]
    n, k = len(starts), bands * rows
    keys, low = np.zeros((n, bands), U64), np.zeros((n, k), np.uint8)
    odds = mix(np.arange(k, dtype=U64), 911) | U64(1)
    for at in range(k):
        least = np.minimum.reduceat(tokens * odds[at], starts) if n else np.zeros(0, U64)
        keys[:, at // rows] = mix(keys[:, at // rows] ^ least, at // rows + 1)
        low[:, at] = mix(least, 5).astype(np.uint8) & np.uint8(3)
    width = -(-k // 64) * 64
    planes = np.zeros((n, BITS, width), np.uint8)
    planes[:, 0, :k], planes[:, 1, :k] = low & 1, low >> 1
    return keys, np.packbits(planes, axis=2).reshape(n, BITS * width // 8).view(U64)


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, until, data, bounds in chunks(batch.column(1)):
                tokens, sizes = shingle_sets(data, bounds, size, lower=True)
                keys, packed = signatures(tokens, sizes, bands, rows)
                has = sizes > 0
                first, buffer = np.concatenate([[0], np.cumsum(sizes)]) * 8, tokens.tobytes()
                ids = [xxhash.xxh3_128_digest(buffer[first[t] : first[t + 1]]) if has[t] else None for t in range(until - row)]
                columns = [
                    batch.column(0).slice(row, until - row),
                    pa.array(ids, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    list_array(signed(packed.reshape(-1)), np.where(has, packed.shape[1], 0), pa.int64()),
                    list_array(signed(keys.reshape(-1)), np.where(has, bands, 0), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "set_id", "n_shingles", "packed", "keys"])

    return run


def estimate(a: str, b: str, minima: int) -> Column:
    """The similarity that the packed low bits in the columns `a` and `b` let expect."""
    words = -(-minima // 64)
    differ = [
        F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]).bitwiseOR(F.col(a)[words + i].bitwiseXOR(F.col(b)[words + i]))) for i in range(words)
    ]
    return F.lit(1.0) - sum(differ[1:], differ[0]) / F.lit(minima * (1 - CHANCE))


def _token_rows(size: int):
    """(cid, tokens) of the classes asked for, in (doc, text, cid, set_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for row, until, data, bounds in chunks(batch.column(1)):
                tokens, sizes = shingle_sets(data, bounds, size, lower=True)
                first, buffer = np.concatenate([[0], np.cumsum(sizes)]) * 8, tokens.tobytes()
                sets = [buffer[first[t] : first[t + 1]] for t in range(until - row)]
                same = [t for t, s in enumerate(sets) if s and xxhash.xxh3_128_digest(s) == wanted[row + t]]
                columns = [batch.column(2).slice(row, until - row).take(pa.array(same, pa.int64())), pa.array([sets[t] for t in same], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "tokens"])

    return run


def _confirm(similarity: float):
    """(u, v) of the linked pairs, from rows (rep, part, role, cid, tokens) in order: a set first, then its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.zeros(0, U64)
        for batch in batches:
            reps, parts, roles, cids = (batch.column(c).to_numpy() for c in ("rep", "part", "role", "cid"))
            sets, u, v = batch.column("tokens"), [], []
            for i in range(len(batch)):
                tokens = np.frombuffer(sets[i].as_buffer(), U64)
                if not roles[i]:
                    held, own = (reps[i], parts[i]), tokens.copy()
                elif held == (reps[i], parts[i]):
                    at = np.searchsorted(own, tokens)
                    at[at == len(own)] = 0
                    both = int((own[at] == tokens).sum())
                    if both >= similarity * (len(own) + len(tokens) - both) - 1e-6:
                        u.append(reps[i])
                        v.append(cids[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _compared(pairs: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """(u, v): those of `pairs` (rep, cid) whose sets in `tokens` (cid, tokens) are similar."""
    counts = pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    limit = max(PART, pairs.count() // 1000)  # so at most a thousand classes are heavy
    heavy = F.broadcast(counts.where(F.col("n") > limit).select("rep", F.ceil(F.col("n") / PART).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("cid"), "parts"), F.lit(0))
    partners = pairs.join(heavy, "rep", "left").select("rep", part.alias("part"), F.lit(1).alias("role"), "cid").join(tokens, "cid")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))
    own = counts.join(heavy, "rep", "left").select("rep", parts.alias("part"), F.lit(0).alias("role"), F.col("rep").alias("cid")).join(tokens, "cid")
    fields = ["rep", "part", "role", "cid", "tokens"]
    rows = partners.select(fields).unionByName(own.select(fields))
    rows = rows.repartition(n_partitions(pairs.sparkSession), "rep", "part").sortWithinPartitions("rep", "part", "role")
    return rows.mapInArrow(released(_confirm(similarity)), "u bigint, v bigint")


def _bits(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(U64).reshape(len(column), -1)


def _plausible(minima: int, least: float):
    """(path, id) of the classes with a plausible partner of another component, in the first bucket that both are in."""
    most = minima * (1 - CHANCE) * (1 - least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            path, tile, block, label = (batch.column(c).to_numpy() for c in ("path", "tile", "block", "label"))
            packed, keys = _bits(batch.column("packed")), _bits(batch.column("keys"))
            words, keep = packed.shape[1] // 2, np.zeros(len(batch), bool)
            for i, j in _pair_chunks(_starts(path, tile)):
                other = (label[i] != label[j]) & _meet(tile, block, i, j)
                i, j = i[other], j[other]
                x = packed[i] ^ packed[j]
                near = np.bitwise_count(x[:, :words] | x[:, words:]).sum(axis=1) <= most
                i, j = i[near], j[near]
                equal = keys[i] == keys[j]
                first = keys[i, equal.argmax(axis=1)] == path[i].view(U64)
                keep[i[first]] = keep[j[first]] = True
            yield batch.select(["path", "id"]).filter(pa.array(keep))

    return run


def _linked(similarity: float):
    """(u, v): each class of a tile that has links to other components there, and the least class that they connect it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            path, tile, block, label, cid = (batch.column(c).to_numpy() for c in ("path", "tile", "block", "label", "id"))
            starts, least = _starts(path, tile), cid.copy()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, U64) for x in batch.column("tokens").slice(a, b - a).to_pylist()]
                sizes = np.array([len(x) for x in sets], np.float64)
                both = _common(sets)
                linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
                linked &= label[a:b, None] != label[None, a:b]
                if tile[a] // TILE != tile[a] % TILE:
                    linked &= block[a:b, None] != block[None, a:b]
                while True:
                    best = np.minimum(least[a:b], np.where(linked, least[None, a:b], np.iinfo(np.int64).max).min(axis=1))
                    if (best == least[a:b]).all():
                        break
                    least[a:b] = best
            moved = least != cid
            yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(least[moved])], names=["u", "v"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(n_partitions(rows.sparkSession), "path", "tile").sortWithinPartitions("path", "tile")


def _rest(buckets: DataFrame, classes: DataFrame, labels: DataFrame, tokens_of, minima: int, similarity: float, limit: int) -> DataFrame:
    """(u, v): links between different components within the buckets of over three classes."""
    named = buckets.where("n > 3").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = materialize(named.select("path", "cid", "n", "label"), "labelled")
    mixed = named.groupBy("path").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("path")
    mixed = materialize(mixed, "mixed")  # as a table, so that a large bucket's rows can be split
    rows = named.join(broadcast_if_small(mixed), "path").join(classes.select("cid", "packed", "keys"), "cid").withColumnRenamed("cid", "id")
    found = _dealt(_tiled(rows, 4 * limit)).mapInArrow(released(_plausible(minima, least_estimate(similarity, minima))), "path bigint, id bigint")
    found = materialize(found.distinct(), "plausible")
    sets = tokens_of(found.select(F.col("id").alias("cid")).distinct())
    counted = found.join(found.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path")
    rows = counted.join(sets.withColumnRenamed("cid", "id"), "id").join(labels.withColumnRenamed("cid", "id"), "id", "left")
    rows = rows.withColumn("label", F.coalesce("label", "id"))
    links = materialize(_dealt(_tiled(rows, limit)).mapInArrow(released(_linked(similarity)), "u bigint, v bigint").distinct(), "rest")
    for table in (named, mixed, found, sets):
        discard(table)
    return links


def find_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    limit: int = LIMIT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`; kept: the row has the least id of its component."""
    minima = bands * rows
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    schema = "doc bigint, set_id binary, n_shingles bigint, packed array<bigint>, keys array<bigint>"
    wide = materialize(named.mapInArrow(released(_sketches(size, bands, rows)), schema), "sketches")
    one = wide.where("doc IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc", "packed", "keys")).alias("f"))
    classes = materialize(one.select(F.monotonically_increasing_id().alias("cid"), "set_id", "f.*"), "classes")
    sets = materialize(wide.select("doc", "set_id", "n_shingles"), "set-ids")
    discard(wide)

    entries = classes.select(F.explode(F.array_distinct("keys")).alias("path"), "cid")
    counts = entries.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("n > 1")
    counts = materialize(counts, "bucket-counts")
    most = max(1000, classes.count() * bands // 1000)  # so at most a thousand buckets have more
    large = F.broadcast(counts.where(F.col("n") > most).withColumnsRenamed({"n": "_n", "lo": "_lo", "hi": "_hi"}))
    marked = entries.join(large, "path", "left")
    buckets = marked.where("_n IS NOT NULL").select("path", "cid", F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    buckets = buckets.unionByName(marked.where("_n IS NULL").select("path", "cid").join(counts.where(F.col("n") <= most), "path"))
    buckets = materialize(buckets, "buckets")
    discard(counts)
    stars = buckets.where("cid <> lo").select(F.col("lo").alias("rep"), "cid")
    stars = stars.unionByName(buckets.where("n > 2 AND cid <> lo AND cid <> hi").select(F.col("hi").alias("rep"), "cid")).distinct()
    packed = classes.select("cid", "packed")
    both = stars.join(packed, "cid").join(packed.select(F.col("cid").alias("rep"), F.col("packed").alias("other")), "rep")
    near = both.where(estimate("packed", "other", minima) >= least_estimate(similarity, minima)).select("rep", "cid")
    near = materialize(near, "near")

    def tokens_of(asked: DataFrame) -> DataFrame:
        """(cid, tokens) of the classes `asked` for, from one document of each."""
        asked = broadcast_if_small(asked.join(classes.select("cid", "doc", "set_id"), "cid"), 100_000)
        found = named.join(asked, "doc").select("doc", "text", "cid", "set_id").mapInArrow(released(_token_rows(size)), "cid bigint, tokens binary")
        return materialize(found.dropDuplicates(["cid"]), "tokens")

    tokens = tokens_of(near.select(F.explode(F.array("rep", "cid")).alias("cid")).distinct())
    links = materialize(_compared(near, tokens, similarity), "links")
    discard(tokens)
    labels = components(links).withColumnsRenamed({"vertex": "cid", "component": "label"})
    links = links.unionByName(_rest(buckets, classes, labels, tokens_of, minima, similarity, limit))
    labels = components(links).withColumnsRenamed({"vertex": "cid", "component": "label"})
    discard(buckets)

    grouped = classes.select("cid", "set_id", "doc").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = grouped.groupBy("label").agg(F.min("doc").alias("component_id"))
    verdicts = materialize(grouped.join(least, "label").select("set_id", "component_id"), "verdicts")
    out = sets.join(verdicts, "set_id", "left").withColumn("component_id", F.coalesce("component_id", "doc"))
    out = out.withColumn("component_id", F.when(F.col("doc").isNotNull(), F.col("component_id")))
    return out.select(F.col("doc").alias(doc_id), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))
