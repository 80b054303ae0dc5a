r"""Removal of lines that repeat an earlier line, up to one edit: a deletion-neighbourhood join.

A line is a \n-split part of a text with a character other than space and the controls 09 to 0D; other lines are kept
as they are. A line goes if an equal line, or one within one insertion, deletion or substitution of a character, occurs
earlier: in a document of smaller id, or above it in the same document. Lines of fewer than `min_fuzzy` characters (none unless asked for) are
compared for equality only. Judged on the input: a line that goes itself still removes later ones.

1. Distinct lines with their first place: an aggregate by two 64-bit hashes, with map-side partial results.
2. Two lines within one edit share a half: the first or the last half, taken by the shorter line's length. Lines that
   share no half with another line cannot have such a neighbour, and emit no variants.
3. The others emit the hashed variants within the edit bound, in the other half: the line without character i together
   with i (equal: a substitution), the line without character i, and the line itself (equal: an insertion). All lines of
   one substitution key are within one edit of each other, and all of one insertion key are within one edit of its whole
   line, so the earliest line of each key is an aggregate and no pairs are emitted. Candidates are then verified on the
   characters.
4. The lines that stay are gathered by their document and joined to the texts.

Defined cases: a null text is an empty text; a document with a null id keeps all its lines and removes none; rows with
the same id are one document, and each keeps the document's first lines; an empty table gives an empty result; columns
`n_lines`, `n_removed` and, in `remove_lines`, the text are replaced, others pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import broadcast_if_small, materialize
from cadenza.llm.tokens import NOT_SPACE, U64, Sums, chunks, list_array, mix, released, signed, slices

MIN_FUZZY = 0
#: Bits of the four halves that a line may share.
FIRST, LAST, FIRST_OF_SHORTER, LAST_OF_SHORTER = 1, 2, 4, 8


def _line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in the text, start, end) of every line with a word."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    text = np.searchsorted(bounds, start, "right") - 1
    # a break at the end of a text begins an empty line, counted with the text before
    keep = start < bounds[-1]
    start, text = start[keep], text[keep]
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1]
    start, text = start[new], text[new]
    stop = np.searchsorted(breaks, start)
    end = np.append(breaks, bounds[-1])[stop]
    end = np.minimum(end, bounds[text + 1])
    words = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    has = words[end] > words[start]
    start, end, text = start[has], end[has], text[has]
    first = np.searchsorted(text, np.arange(len(bounds) - 1))
    return text, np.arange(len(text)) - first[text], start, end


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of every line."""
    joined = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def _lines(min_fuzzy: int):
    """(h1, h2, doc, line, halves): the hashes of the halves of every line, empty for short lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, until, data, bounds in chunks(batch.column(1)):
                raw = data.tobytes()
                text, number, start, end = _line_bounds(data, bounds)
                hashes = _digests(raw, start, end)
                points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
                place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                a, b = place[start], place[end]
                n, sums = b - a, Sums(mix(points.astype(U64)))
                keys = []
                for base in (n, n - 1):
                    half = base // 2
                    first = sums.span(a, a + half)
                    last = sums.span(b - (base - half), b)
                    keys += [mix(first ^ mix(base * 2, 1)), mix(last ^ mix(base * 2 + 1, 1))]
                long = n >= min_fuzzy
                counts = np.where(long, 4, 0)
                values = np.stack(keys, axis=1)[long].ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[:, 0]),
                        pa.array(hashes[:, 1]),
                        pa.array(ids[row:until].astype(np.int64)[text]),
                        pa.array(number, pa.int32()),
                        list_array(signed(values), counts, pa.int64()),
                    ],
                    names=["h1", "h2", "doc", "line", "halves"],
                )

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, whole, h1, doc, line) of the variants of the lines asked for, in (doc, text, lines: h1, line, mask)."""
    for batch in slices(batches, 1):
        ids = batch.column(0).to_pylist()
        texts, asked = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for doc, text, wanted in zip(ids, texts, asked, strict=True):
            lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            for want in wanted:
                if want["line"] >= len(lines) or xxhash.xxh3_128_digest(lines[want["line"]].encode())[:8] != want["h1"].to_bytes(8, "little", signed=True):
                    continue  # another row of the same id
                x = np.frombuffer(lines[want["line"]].encode("utf-32-le"), "<u4").astype(U64)
                n, mask, sums = len(x), want["mask"], Sums(mix(x))
                at, zero = np.arange(n), np.zeros(n, np.int64)
                before = sums.span(zero, at)
                after = sums.span(at + 1, zero + n)
                without = mix(before * U64(3) + mix(at, 2)) ^ mix(after, 4)  # for a substitution: both sides and the place
                half, less = n // 2, (n - 1) // 2
                here = ((at >= half) & bool(mask & FIRST)) | ((at < half) & bool(mask & LAST))
                gone = ((at >= less) & bool(mask & FIRST_OF_SHORTER)) | ((at <= less) & bool(mask & LAST_OF_SHORTER))
                keys = [without[here]]
                whole = [np.zeros(int(here.sum()), bool)]
                if gone.any():
                    shorter = np.unique(_shorter_hashes(sums, at[gone], n))
                    keys.append(shorter)
                    whole.append(np.zeros(len(shorter), bool))
                if mask & (FIRST | LAST):
                    keys.append(_whole_hash(sums, n))
                    whole.append(np.ones(1, bool))
                keys, whole = np.concatenate(keys), np.concatenate(whole)
                m = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys)), pa.array(whole), pa.array([want["h1"]] * m, pa.int64()), pa.array([doc] * m, pa.int64()), pa.array([want["line"]] * m, pa.int32())],
                    names=["key", "whole", "h1", "doc", "line"],
                )


def _shorter_hashes(sums: Sums, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of a line of n characters without each character of `at`: what the shorter line itself would have."""
    return mix(sums.total[at] - sums.total[0] + (sums.total[n] - sums.total[at + 1]) * sums.backward[1], 6)


def _whole_hash(sums: Sums, n: int) -> np.ndarray:
    return mix(sums.total[n : n + 1] - sums.total[:1], 6)


def within_one_edit(x: str, y: str) -> bool:
    """Whether at most one insertion, deletion or substitution of a character makes x of y."""
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    i = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), len(x))  # noqa: B905
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        h1, out = [], []
        for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            asked = {w["h1"] for w in wanted}
            for line in dict.fromkeys((text or "").split("\n")):
                h = int.from_bytes(xxhash.xxh3_128_digest(line.encode())[:8], "little", signed=True)
                if h in asked:
                    h1.append(h)
                    out.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(out, pa.string())], names=["h1", "text"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        keep = pa.array([within_one_edit(a, b) for a, b in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["h1"])


def near_repeats(named: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1) of distinct lines that have a neighbour within one edit and an earlier first place."""
    halves = distinct.where(F.size("halves") > 0).select("h1", "doc", "line", F.posexplode("halves").alias("part", "half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    asked = halves.join(shared, "half").groupBy("h1", "doc", "line").agg(F.bit_or(F.expr("shiftleft(1, part)")).alias("mask"))
    asked = materialize(asked.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("h1", "line", "mask")).alias("lines")), "asked")
    rows = named.select("_doc", "_text").join(broadcast_if_small(asked, 200_000), "_doc")
    variants = materialize(rows.mapInArrow(released(_variants), "key bigint, whole boolean, h1 bigint, doc bigint, line int"), "variants")
    place = F.struct("doc", "line", "h1")
    first = variants.groupBy("key").agg(
        F.min(F.when(F.col("whole"), place)).alias("line_itself"), F.min(F.when(~F.col("whole"), place)).alias("shorter"), F.count(F.lit(1)).alias("n")
    )
    first = first.where("n > 1")
    met = variants.join(first, "key")
    # of a key without a whole line: substitutions, or lines that have a deletion in common (verified below)
    keeper = F.when(F.col("whole") | F.col("line_itself").isNull(), F.col("shorter")).otherwise(F.col("line_itself"))
    pairs = met.select("h1", "doc", "line", keeper.alias("k")).where("k IS NOT NULL AND (k.doc < doc OR (k.doc = doc AND k.line < line))")
    pairs = materialize(pairs.select("h1", F.col("k.h1").alias("other")).where("h1 <> other").distinct(), "pairs")
    texts = materialize(rows.mapInArrow(released(_line_texts), "h1 bigint, text string").dropDuplicates(["h1"]), "lines")
    both = pairs.join(texts.withColumnRenamed("text", "x"), "h1").join(texts.select(F.col("h1").alias("other"), F.col("text").alias("y")), "other")
    return both.select("h1", "x", "y").mapInArrow(released(_verified), "h1 bigint").distinct()


def _apply(n_rest: int):
    """Columns of (rest, doc, text, kept hashes) to rest, text, n_lines and n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n_rest + 1):
            out, n_lines, n_removed = [], [], []
            for doc, text, kept in zip(*(batch.column(n_rest + i).to_pylist() for i in range(3)), strict=True):
                lines, count, gone, stay = (text or "").split("\n"), 0, 0, set(kept or ())
                left = []
                for line in lines:
                    if line.strip(" \t\n\x0b\x0c\r"):
                        count += 1
                        if doc is not None:
                            h = int.from_bytes(xxhash.xxh3_128_digest(line.encode())[:8], "little", signed=True)
                            if h not in stay:
                                gone += 1
                                continue
                            stay.discard(h)
                    left.append(line)
                out.append("\n".join(left))
                n_lines.append(count)
                n_removed.append(gone)
            columns = [*batch.columns[:n_rest], pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_rest], "_kept", "_n_lines", "_n_removed"])

    return run


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_edits: int = 1, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """`docs` with the lines that stay as `text`, and n_lines and n_removed (long)."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    named = docs.select(*rest, F.col(doc_id).cast("bigint").alias("_doc"), F.col(text).alias("_text"))
    lines = named.where("_doc IS NOT NULL").select("_doc", "_text").mapInArrow(
        released(_lines(min_fuzzy)), "h1 bigint, h2 bigint, doc bigint, line int, halves array<bigint>"
    )
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", "halves")).alias("f"))
    distinct = materialize(distinct.select("h1", "h2", "f.*"), "lines")
    stay = distinct.select("h1", "doc")
    if max_edits:
        gone = materialize(near_repeats(named, distinct), "near")
        stay = stay.join(broadcast_if_small(gone, 200_000), "h1", "left_anti")
    stay = stay.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("h1").alias("_stay"))
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in rest) + "_kept string, _n_lines bigint, _n_removed bigint"
    joined = named.join(stay, "_doc", "left").select(*rest, "_doc", "_text", "_stay")
    out = joined.mapInArrow(released(_apply(len(rest))), schema)
    return out.withColumnsRenamed({"_kept": text, "_n_lines": "n_lines", "_n_removed": "n_removed"})


def keep_first_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` with the lines that stay as `text` and its length as `n_chars`; documents of which no line is left go."""
    columns = docs.columns
    kept = remove_lines(docs, doc_id, text)
    kept = kept.where("n_lines > n_removed OR n_removed = 0")
    if n_chars in columns:
        kept = kept.withColumn(n_chars, F.length(text).cast(dict(docs.dtypes)[n_chars]))
    return kept.select(*columns)
