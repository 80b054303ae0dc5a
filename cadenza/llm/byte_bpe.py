"""Byte-level BPE in Spark higher-order functions.

A first pass over all texts counts in how many tasks each piece (white space and the word after it) occurs, with one
shuffle. The SHARED pieces that most tasks have are encoded once and their ids, at most SHARED * SHARED_BYTES bytes of
pieces, are broadcast: they save work, the other pieces are encoded in the tasks that meet them, with the same result.

In the second pass the texts of a task are packed into blocks of a megabyte: one row with the distinct words (matches of
the pattern, as bytes) that are not in shared pieces and that the task has not met before and, for every document, the
numbers of its pieces or words. A task forgets its words when it has met DICTIONARY of them, so its memory is bounded. On
these rows, JVM-side, a fold merges the byte array of each distinct word: every step joins the adjacent pair of least
rank, the leftmost of equals, until no pair has a rank. The ranks are one literal, bound once a block. Words of more than
LONG bytes keep their pieces in groups of about the square root of their number, with each group's least pair: a step
costs time in proportion to a group's size and the number of groups. Decoding concatenates the binary pieces of the ids.

Defined cases: a null or empty text has no ids; a word without merges keeps one id a byte (the ranks hold all 256
bytes); other columns pass through, `ids` and `decoded` (digests: `n_tokens`, `ids_sha256`, `decoded_sha256`) replace
input columns of the same name. Repeated rows and null ids are rows like others. A word of 2**27 bytes or more is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import discard, materialize, short_plans, tidy
from cadenza.llm.tokens import U64, Words, chunks, list_array, released, span_hashes

BLOCK_BYTES = 1_000_000
DICTIONARY = 400_000
#: Pieces that are encoded once for all tasks: so many, of so many bytes at most.
SHARED, SHARED_BYTES = 1 << 19, 64
LONG = 1024
#: A piece's id has so many bits, the place of its first byte in its word so many.
ID_BITS, PLACE_BITS = 18, 27
NO_RANK = (1 << ID_BITS) - 1
#: White space of the pattern; between another character and one of these every match ends.
GAP = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{GAP}]*[^{GAP}]+|[{GAP}]+")
#: One of these that is not ASCII, with an ASCII one after it, in UTF-8.
ODD_GAP = re.compile("|".join(c for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000").join(["(?:", ")[\t-\r ]"]).encode())


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """Bytes to rank of a file with a base64 word and its rank in every line."""
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.readlines())


class _Numbers(dict):
    """Numbers keys in the order in which they are first met."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _ragged(first: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + counts[i]] one after the other."""
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return values[np.repeat(first, counts) + inner]


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the pieces: they end where an ASCII word ends and at the ends of texts."""
    ends = np.unique(np.concatenate([Words(data, bounds).end, bounds[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return starts, ends, span_hashes(data, starts, ends)


def _find(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each hash is among the sorted `known`, its place there)."""
    at = np.searchsorted(known, hashes)
    found = np.zeros(len(hashes), bool)
    inside = at < len(known)
    found[inside] = known[at[inside]] == hashes[inside]
    return found, at


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pieces of a task's texts, anew after DICTIONARY of them."""
    known = np.zeros(0, U64)
    for batch in batches:
        for _, _, data, bounds in chunks(batch.column(0), BLOCK_BYTES):
            if ODD_GAP.search(data.tobytes()):
                continue
            starts, ends, hashes = _cut(data, bounds)
            some, first = np.unique(hashes, return_index=True)
            found, _ = _find(known, some)
            fresh = first[~found & (ends[first] - starts[first] <= SHARED_BYTES)]
            known = np.zeros(0, U64) if len(known) > DICTIONARY else np.sort(np.concatenate([known, some[~found]]))
            sizes = ends[fresh] - starts[fresh]
            raw = _ragged(starts[fresh], sizes, data)
            piece = pa.Array.from_buffers(pa.binary(), len(fresh), [None, pa.py_buffer(_bounds(sizes).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([piece], names=["piece"])


class _Pieces:
    """Numbers the units of texts (shared pieces, then the words of other pieces) as a task meets them."""

    def __init__(self, pattern: str, shared: np.ndarray):
        self.find = regex.compile(pattern).findall
        self.shared = shared
        self.words = _Numbers()
        self.hashes, self.numbers = np.zeros(0, U64), np.zeros(0, np.int64)  # of the known pieces, by hash
        self.counts, self.first, self.values = (np.zeros(0, np.int64) for _ in range(3))  # words of each piece

    def add(self, pieces: Iterable[str]) -> None:
        words, find, counts, values = self.words, self.find, [], []
        for p in pieces:
            own = find(p)
            counts.append(len(own))
            values += [words[w] for w in own]
        counts = np.array(counts, np.int64)
        self.first = np.concatenate([self.first, np.cumsum(counts) - counts + len(self.values)])
        self.counts = np.concatenate([self.counts, counts])
        self.values = np.concatenate([self.values, np.array(values, np.int64) + len(self.shared)])

    def number(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers of all texts, units of each text)."""
        starts, ends, hashes = _cut(data, bounds)
        some, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        common, unit = _find(self.shared, some)
        rare = np.flatnonzero(~common)
        known, at = _find(self.hashes, some[rare])
        number = np.zeros(len(rare), np.int64)
        number[known] = self.numbers[at[known]]
        fresh = rare[~known]
        number[~known] = len(self.counts) + np.arange(len(fresh))
        raw = data.tobytes()
        self.add(raw[a:b].decode() for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True))
        order = np.argsort(np.concatenate([self.hashes, some[fresh]]), kind="stable")
        self.hashes = np.concatenate([self.hashes, some[fresh]])[order]
        self.numbers = np.concatenate([self.numbers, number[~known]])[order]
        sizes = np.ones(len(some), np.int64)
        sizes[rare] = self.counts[number]
        units = np.zeros(sizes.sum(), np.int64)
        place = np.cumsum(sizes) - sizes
        units[place[common]] = unit[common]
        units[_ragged(place[rare], sizes[rare], np.arange(len(units)))] = _ragged(self.first[number], self.counts[number], self.values)
        counts = sizes[inverse]
        until = np.searchsorted(ends, bounds[1:], "right")  # pieces up to the end of each text
        return _ragged(place[inverse], counts, units), np.diff(_bounds(counts)[np.concatenate([[0], until])])


def _pack(pattern: str, n_rest: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value if shared is not None else np.zeros(0, U64)
        pieces, known = _Pieces(pattern, hashes), 0
        for batch in batches:
            texts = batch.column(n_rest)
            rest = pa.StructArray.from_arrays(batch.columns[:n_rest], names=batch.schema.names[:n_rest])
            for row, until, data, bounds in chunks(texts, BLOCK_BYTES):
                forget = max(len(pieces.words), len(pieces.counts)) > DICTIONARY
                if forget:
                    pieces, known = _Pieces(pattern, hashes), 0
                if ODD_GAP.search(data.tobytes()):
                    refs, counts = [], []
                    for t in range(until - row):  # a gap that is not ASCII may precede a space: cut at all gaps
                        own = [pieces.words[w] for p in PIECE.findall(data[bounds[t] : bounds[t + 1]].tobytes().decode()) for w in pieces.find(p)]
                        refs += own
                        counts.append(len(own))
                    refs, counts = np.array(refs, np.int64) + len(hashes), np.array(counts, np.int64)
                else:
                    refs, counts = pieces.number(data, bounds)
                fresh = [w.encode() for w in islice(pieces.words, known, None)]
                known = len(pieces.words)
                sizes = np.array([len(w) for w in fresh], np.int64)
                if len(sizes) and sizes.max() >= 1 << PLACE_BITS:
                    raise ValueError(f"a word of {sizes.max()} bytes: the most is {(1 << PLACE_BITS) - 1}")
                inner = list_array(np.frombuffer(b"".join(fresh), np.uint8).astype(np.int16), sizes, pa.int16())
                one = pa.array(np.array([0, until - row], np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(one, rest.slice(row, until - row)),
                        list_array(counts, np.array([until - row]), pa.int32()),
                        list_array(refs, np.array([len(refs)]), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.array([0, len(fresh)], np.int32)), inner),
                        pa.array([forget]),
                    ],
                    names=["_rest", "_counts", "_refs", "_words", "_forget"],
                )

    return run


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once (a fold without steps; unlike a transform it does not copy the result)."""
    return F.aggregate(F.array(F.lit(0)), value, lambda held, _: held, body)


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the rank of their concatenation, for every way to join two pieces into a third."""
    pairs = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


def _merged(piece: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    ids = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    while len(ids) > 1:
        rank, at = min((pairs.get(p, NO_RANK), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
        if rank == NO_RANK:
            break
        ids[at : at + 2] = [rank]
    return ids


def displaced(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int | None]]:
    """(shift, slots) with slots[shift[left] + right] = left << ID_BITS | rank for every pair; each left id's shift is
    the first at which its pairs meet none of those before it. Slots that no pair has are None."""
    rights: dict[int, list[int]] = {}
    for left, right in pairs:
        rights.setdefault(left, []).append(right)
    n_ids, window = max(map(max, pairs), default=0) + 1, 4096
    used = np.zeros(n_ids + window, bool)
    shift, start, before = [0] * n_ids, 0, 0
    for left in sorted(rights, key=lambda k: (-len(rights[k]), k)):
        own = np.array(rights[left])
        start, before = (start if before == len(own) else 0), len(own)
        while True:
            if start + n_ids + window > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            taken = np.logical_or.reduce([used[start + r : start + r + window] for r in own.tolist()])
            if not taken.all():
                break
            start += window
        shift[left] = start + int(taken.argmin())
        used[shift[left] + own] = True
    slots: list[int | None] = [None] * (int(used.nonzero()[0].max(initial=0)) + 1)
    for (left, right), rank in pairs.items():
        slots[shift[left] + right] = (left << ID_BITS) + rank
    return shift, slots


def rank_map(ranks: dict[bytes, int]) -> tuple[Column, dict[str, int]]:
    """The literal rank map, and the pieces that merges do not reach: their merged ids (comma-joined) to their own id.

    The literal: `bytes`, the id of every byte; `shift` and `slots`, the rank of every pair that merges.
    """
    if max(ranks.values()) >= NO_RANK:
        raise ValueError(f"ranks must be less than {NO_RANK}")
    pairs = merge_pairs(ranks)
    shift, slots = displaced(pairs)
    table = {"bytes": [ranks[bytes([i])] for i in range(256)], "shift": shift, "slots": slots}
    literal = F.from_json(F.lit(json.dumps(table)), "bytes array<bigint>, shift array<int>, slots array<bigint>")
    whole = {}
    for piece, rank in ranks.items():
        ids = _merged(piece, ranks, pairs)
        if ids != [rank]:
            whole[",".join(map(str, ids))] = rank
    return literal, whole


def fold_merges(word: Column, table: Column, whole: dict[str, int]) -> Column:
    """The ids (array<int>) that ranked merges give a word (array of byte values); a word that has a rank is one id.

    The state has a number for every piece, from high bits to low: the rank of its pair with the next piece, the
    place of its first byte, its id. Its minimum is the pair to merge, the leftmost of equal ranks.
    """
    high = ID_BITS + PLACE_BITS
    unmerged = F.lit(NO_RANK << high)
    low = lambda code, bits: code.bitwiseAND(F.lit((1 << bits) - 1))
    id_of = lambda code: low(code, ID_BITS)
    ids = lambda codes: F.transform(codes, lambda x: id_of(x).cast("int"))

    def rank(left: Column, right: Column) -> Column:
        slot = F.get(table["shift"], left.cast("int")) + right.cast("int")
        return F.least(F.get(table["slots"], slot).bitwiseXOR(F.shiftleft(left, ID_BITS)), F.lit(NO_RANK).cast("bigint"))

    def merge(state: Column, least: Column) -> Column:
        def at(i: Column) -> Column:
            fresh, before = F.shiftrightunsigned(least, high), F.get(state, i - 2)
            place = least.bitwiseAND(F.lit(((1 << PLACE_BITS) - 1) << ID_BITS))
            own = F.shiftleft(rank(fresh, id_of(F.get(state, i + 1))), high).bitwiseOR(place).bitwiseOR(fresh)
            prior = F.shiftleft(rank(id_of(before), fresh), high).bitwiseOR(low(before, high))
            inside = F.concat(F.slice(state, 1, i - 2), F.array(prior, own), F.slice(state, i + 2, F.size(state)))
            return F.when(i == 1, F.concat(F.array(own), F.slice(state, 3, F.size(state)))).otherwise(inside)

        return _let(F.array_position(state, least).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), lambda least: F.when(least < unmerged, merge(state, least)).otherwise(state))

    width = F.ceil(F.sqrt(F.size(word) / 6)).cast("int")

    def grouped(codes: Column) -> Column:
        """(groups of `width` pieces, the least code of each)."""
        last = F.ceil(F.size(codes) / width).cast("int") - 1
        parts = F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(codes, j * width + 1, width))
        return _let(parts, lambda p: F.struct(p.alias("groups"), F.transform(p, F.array_min).alias("least")))

    def long_step(state: Column, _: Column) -> Column:
        groups, mins = state["groups"], state["least"]

        def put(k: Column, least: Column) -> Column:
            """Group k (from 1) merged with the one before and the two after it, which have all that the merge reads."""
            first = F.greatest(k - 1, F.lit(1))
            merged = _let(F.flatten(F.slice(groups, first, k - first + 3)), lambda codes: merge(codes, least))
            around = lambda old, new: F.concat(F.slice(old, 1, first - 1), new, F.slice(old, k + 3, F.size(old)))
            return _let(
                _let(merged, grouped),
                lambda new: F.struct(around(groups, new["groups"]).alias("groups"), around(mins, new["least"]).alias("least")),
            )

        at = lambda least: _let(F.array_position(mins, least).cast("int"), lambda k: put(k, least))
        return _let(F.array_min(mins), lambda least: F.when(least < unmerged, at(least)).otherwise(state))

    byte = lambda x: F.get(table["bytes"], x.cast("int"))
    code = lambda x, i: F.shiftleft(rank(byte(x), byte(F.get(word, i + 1))), high).bitwiseOR(F.shiftleft(i.cast("bigint"), ID_BITS)).bitwiseOR(byte(x))
    singles, steps = F.transform(word, code), F.sequence(F.lit(2), F.size(word))
    folded = (
        F.when(F.size(word) == 1, F.transform(word, lambda x: byte(x).cast("int")))
        .when(F.size(word) <= LONG, F.aggregate(steps, singles, step, ids))
        .otherwise(F.aggregate(steps, _let(singles, grouped), long_step, lambda state: ids(F.flatten(state["groups"]))))
    )
    if not whole:
        return folded
    known = F.from_json(F.lit(json.dumps(whole)), "map<string,int>")
    one = lambda x: F.try_element_at(known, F.array_join(x, ","))
    return _let(folded, lambda x: F.when(one(x).isNotNull(), F.array(one(x))).otherwise(x))


def piece_table(ranks: dict[bytes, int]) -> pa.BinaryArray:
    """The bytes of every id."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def _concatenated(ids: pa.ListArray, parts: pa.Array, gap: bytes | str) -> pa.Array:
    """The parts of each row's ids, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(_bounds(np.asarray(ids.value_lengths(), np.int64)), pa.int32()), parts), gap)


class _Units:
    """The ids of units, their bytes (the binary pieces of the ids, concatenated) and their ids as comma-joined text."""

    def __init__(self, ids: pa.ListArray, pieces: pa.BinaryArray):
        self.sizes, self.values = np.asarray(ids.value_lengths(), np.int64), ids.flatten().to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        parts = [ids.slice(at, 1 << 16) for at in range(0, len(ids), 1 << 16)] or [ids]
        self.raw = pa.concat_arrays([_concatenated(x, pieces.take(x.flatten()), b"") for x in parts])
        self.texts = pa.concat_arrays([_concatenated(x, x.flatten().cast(pa.string()), ",") for x in parts])
        pa.default_memory_pool().release_unused()

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        return _ragged(self.first[at], self.sizes[at], self.values), self.sizes[at], self.raw.take(pa.array(at)), self.texts.take(pa.array(at))


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    values, sizes, raw, texts = zip(*parts, strict=True)
    return np.concatenate(values), np.concatenate(sizes), pa.concat_arrays(raw), pa.concat_arrays(texts)


def _unpack(names: list[str], digest: bool, pieces, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        common = None if shared is None else _Units(list_array(*reversed(shared.value), pa.int32()), table)
        n_shared = 0 if common is None else len(common.sizes)
        known: list[_Units] = []  # of each block since the last forgetting
        for batch in batches:
            for k in range(len(batch)):
                if batch.column(4)[k].as_py():
                    known = []
                rest = batch.column(0).slice(k, 1).flatten()
                counts = batch.column(1).slice(k, 1).flatten().to_numpy().astype(np.int64)
                refs = batch.column(2).slice(k, 1).flatten().to_numpy()
                known.append(_Units(batch.column(3).slice(k, 1).flatten(), table))
                # the units of this block, by where they are kept
                ends = _bounds([n_shared, *(len(x.sizes) for x in known)])
                met = np.zeros(ends[-1], bool)
                met[refs] = True
                units, at = np.flatnonzero(met), (np.cumsum(met) - 1)[refs]
                cuts = np.searchsorted(units, ends)
                values, sizes, raw, texts = _joined([x.take(units[a:b] - e) for x, a, b, e in zip([common, *known], cuts[:-1], cuts[1:], ends[:-1], strict=True) if x is not None])
                bounds = pa.array(_bounds(counts), pa.int32())
                joined = lambda parts, gap, at=pa.array(at), bounds=bounds: pc.binary_join(pa.ListArray.from_arrays(bounds, parts.take(at)), gap)
                n_tokens = np.diff(_bounds(sizes[at])[_bounds(counts)])
                decoded, columns = joined(raw, b""), list(rest.flatten())
                if digest:
                    columns += [
                        pa.array(n_tokens, pa.int64()),
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined(texts, ",")], pa.string()),
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "_n_tokens", "_ids_sha256", "_decoded_sha256"])
                else:
                    first = np.cumsum(sizes) - sizes
                    columns += [list_array(_ragged(first[at], sizes[at], values), n_tokens, pa.int32()), decoded]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "_ids", "_decoded"])

    return run


def common_pieces(docs: DataFrame, text: str, most: int) -> DataFrame:
    """(piece): those that most tasks have, two at least, and not more than `most`: all that are in as many tasks or more."""
    found = docs.select(F.col(text).alias("_text")).mapInArrow(released(_distinct), "piece binary")
    counted = materialize(found.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pieces")
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, None
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):  # a few hundred rows at most
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    kept = materialize(counted.where(step >= F.lit(least)).select("piece") if least is not None else counted.select("piece").limit(0), "common-pieces")
    discard(counted)
    return kept


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, added: tuple[str, ...], kinds: str, digest: bool, share: bool = True) -> DataFrame:
    sc, literal, whole = docs.sparkSession.sparkContext, *rank_map(ranks)
    table = piece_table(ranks)
    rest = [c for c in docs.columns if c != text and c not in added]
    types = dict(docs.dtypes)
    fields = ", ".join(f"`{c}`: {types[c]}" for c in rest)
    schema = f"_rest array<struct<{fields}>>, _counts array<int>, _refs array<int>, _words array<array<smallint>>, _forget boolean"

    def folded(rows: DataFrame, names: list[str], shape: str, hashes) -> DataFrame:
        packed = rows.mapInArrow(released(_pack(pattern, len(names), hashes)), shape)
        ids = _let(literal, lambda t: F.transform("_words", lambda w: fold_merges(w, t, whole)))
        return packed.select("_rest", "_counts", "_refs", ids.alias("_ids"), "_forget")

    hashes = units = None
    pieces = sc.broadcast(table)
    if share:
        common = common_pieces(docs, text, SHARED).select("piece", F.col("piece").cast("string").alias("_text"))
        shape = schema.replace(fields, "`piece`: binary")
        coded = folded(common, ["piece"], shape, None).mapInArrow(released(_unpack(["piece"], False, pieces, None)), "piece binary, _ids array<int>, _decoded binary")
        with short_plans(docs.sparkSession):
            got = coded.select("piece", "_ids").toArrow()
        if len(got):
            found = np.concatenate([span_hashes(data, bounds[:-1], bounds[1:]) for part in got.column(0).chunks for _, _, data, bounds in chunks(part)])
            order = np.argsort(found)
            ids = got.column(1).combine_chunks().take(pa.array(order))
            hashes = sc.broadcast(found[order])
            units = sc.broadcast((np.asarray(ids.value_lengths(), np.int32), ids.flatten().to_numpy()))
        del got
    tidy()
    schema_out = "".join(f"`{c}` {types[c]}, " for c in rest) + kinds
    packed = folded(docs.select(*rest, F.col(text).alias("_text")), rest, schema, hashes)
    out = packed.mapInArrow(released(_unpack(rest, digest, pieces, units)), schema_out).withColumnsRenamed({f"_{c}": c for c in added})
    if not digest:
        return out
    with short_plans(docs.sparkSession):  # digests are short, so they are written here, and nothing is left in driver or executors
        out = materialize(out, "digests")
    for sent in (pieces, hashes, units):
        if sent is not None:
            sent.destroy()
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """`docs` without `text`, with `ids` (array<int>) and `decoded` (binary, from the ids)."""
    return _coded(docs, ranks, pattern, text, ("ids", "decoded"), "_ids array<int>, _decoded binary", False)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """`docs` without `text`, with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and bytes themselves."""
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    return _coded(docs, ranks, pattern, text, added, "_n_tokens bigint, _ids_sha256 string, _decoded_sha256 string", True)
