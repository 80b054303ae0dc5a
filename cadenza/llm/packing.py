"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are tokenized (a public vocabulary; `ranks` and `pattern` are parameters), and documents longer than a row are split
into pieces without loss. A hash of document and place deals the pieces out into groups of about `group_tokens` tokens;
their number follows from the bytes of all texts, so which pieces share a group, and so every row of the result, depends
on the documents alone, not on how they are partitioned. In a group the longest piece goes first, each into the row with the
least room that still suffices; a segment tree over the room sizes finds it in log(capacity) steps.

A row of the result: `pack` (the group), `row`, `n_tokens`, `input_ids` (`capacity` little-endian unsigned numbers of 2 or
4 bytes, filled up with pad_id), `position_ids` (the same form, from 0 again at every piece, 0 where filled up),
`cu_seqlens` (0 and the end of each piece), `doc_ids` and `starts` (each piece's document and its first token's place in
that document). `write_shards` writes one row for each group: the matrices of all its rows, and an index of the shards.

Defined cases: null and empty texts have no tokens and are in no row; repeated rows are packed as often as they occur;
a null id stays null; other columns do not pass; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.tokens import chunks, released

CAPACITY = 2048
GROUP_TOKENS = 4 << 20
#: Bytes of text for one token, about; only the number of groups follows from it.
BYTES_OF_TOKEN = 3


class Rooms:
    """A segment tree over room sizes: rows by the room they have left, and the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the smallest room of at least `least`, taken out; None if there is none."""
        at, count = self.leaves + least, self.count
        if not count[at]:
            while at > 1 and not (at % 2 == 0 and count[at + 1]):  # up to where a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each row, in the order in which they were placed."""
    rooms, rows = Rooms(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[piece])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.add(room - sizes[piece], row)
    return rows


def _packed(group: int, docs: list[pa.Array], starts: list[int], pieces: list[bytes], capacity: int, width: np.dtype, pad_id: int) -> pa.RecordBatch:
    """The rows of one group, from its pieces in decreasing order."""
    ids = [np.frombuffer(x, width) for x in pieces]
    rows = best_fit_decreasing([len(x) for x in ids], capacity)
    matrix = np.full((len(rows), capacity), pad_id, width)
    places = np.zeros((len(rows), capacity), width)
    ends = []
    for r, row in enumerate(rows):
        bounds = [0]
        for piece in row:
            at, n = bounds[-1], len(ids[piece])
            matrix[r, at : at + n] = ids[piece]
            places[r, at : at + n] = np.arange(n)
            bounds.append(at + n)
        ends.append(bounds)
    owners = pa.chunked_array(docs).combine_chunks().take(pa.array([p for row in rows for p in row], pa.int64()))
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"{group:08d}"] * len(rows), pa.string()),
            pa.array(range(len(rows)), pa.int32()),
            pa.array([b[-1] for b in ends], pa.int32()),
            pa.array([x.tobytes() for x in matrix], pa.binary()),
            pa.array([x.tobytes() for x in places], pa.binary()),
            pa.array(ends, pa.list_(pa.int32())),
            pa.ListArray.from_arrays(offsets, owners),
            pa.array([[starts[p] for p in row] for row in rows], pa.list_(pa.int32())),
        ],
        names=["pack", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
    )


class Tokens:
    """Ids of texts by a public vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each)."""
        ids = [np.array(self.encoding.encode_ordinary(raw[a:b].decode()), np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.concatenate(ids), np.cumsum([0, *map(len, ids)])


def pack(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
    pad_id: int = 0,
) -> DataFrame:
    """The rows described above for all documents."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary, of fixed size
    width = np.dtype("<u2") if max([pad_id, capacity, *ranks.values()]) < 1 << 16 else np.dtype("<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value, pattern)
        for batch in batches:
            for row, until, data, bounds in chunks(batch.column(1), 1 << 20):
                ids, ends = tokens.of(data.tobytes(), bounds)
                ids = ids.astype(width)
                cuts = [(d, at, min(at + capacity, int(ends[d + 1]))) for d in range(until - row) for at in range(int(ends[d]), int(ends[d + 1]), capacity)]
                columns = [
                    batch.column(0).slice(row, until - row).take(pa.array([d for d, _, _ in cuts], pa.int64())),
                    pa.array([a - int(ends[d]) for d, a, _ in cuts], pa.int32()),
                    pa.array([b - a for _, a, b in cuts], pa.int32()),
                    pa.array([ids[a:b].tobytes() for _, a, b in cuts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "n", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, starts, ids = None, [], [], []
        for batch in batches:
            groups = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)] if len(groups) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if docs and groups[a] != now:
                    yield _packed(now, docs, starts, ids, capacity, width, pad_id)
                    docs, starts, ids = [], [], []
                now = int(groups[a])
                docs.append(batch.column("doc").slice(a, b - a))
                starts += batch.column("start").slice(a, b - a).to_pylist()
                ids += batch.column("ids").slice(a, b - a).to_pylist()
        if docs:
            yield _packed(now, docs, starts, ids, capacity, width, pad_id)

    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups = max(1, -(-size // (BYTES_OF_TOKEN * group_tokens)))
    found = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).mapInArrow(released(pieces), f"doc {kind}, start int, n int, ids binary")
    found = found.withColumn("group", F.pmod(F.xxhash64("doc", "start", "ids"), F.lit(groups)).cast("int"))
    found = found.repartitionById(groups, F.col("group")).sortWithinPartitions("group", F.desc("n"), "doc", "start", "ids")
    schema = f"pack string, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<int>"
    return found.select("group", "doc", "start", "ids").mapInArrow(released(packed), schema)


def write_shards(packed: DataFrame, path: str) -> None:
    """`packed` as one row for each group under `path/shards` (the rows' matrices one after the other), and `path/index`.

    The index has for each shard its rows, tokens and pieces, and the tokens of all shards before it, so that a reader finds
    the shard of any token. A group has a bounded number of tokens, and so a shard.
    """
    spark = packed.sparkSession
    rows = packed.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("row", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"))).alias("r"))
    hexed = lambda c: F.unhex(F.array_join(F.transform(f"r.{c}", F.hex), "")).alias(c)
    shards = rows.select(
        "pack", F.size("r").alias("n_rows"), hexed("input_ids"), hexed("position_ids"), F.col("r.cu_seqlens").alias("cu_seqlens"), F.col("r.doc_ids").alias("doc_ids"), F.col("r.starts").alias("starts")
    )
    shards.write.mode("overwrite").parquet(f"{path}/shards")
    counted = spark.read.parquet(f"{path}/shards").select(
        "pack",
        "n_rows",
        F.aggregate("cu_seqlens", F.lit(0).cast("bigint"), lambda n, x: n + F.element_at(x, -1)).alias("n_tokens"),
        F.aggregate("starts", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)).alias("n_pieces"),
    )
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted.withColumn("tokens_before", before).write.mode("overwrite").parquet(f"{path}/index")  # a short row for each shard


def read_shard(spark: SparkSession, path: str, pack: str, capacity: int = CAPACITY) -> dict[str, object]:
    """One shard: `input_ids` and `position_ids` as matrices, `cu_seqlens`, `doc_ids` and `starts` as lists for each row."""
    row = spark.read.parquet(f"{path}/shards").where(F.col("pack") == pack).first()
    width = len(row.input_ids) // (row.n_rows * capacity)
    matrix = lambda raw: np.frombuffer(raw, f"<u{width}").reshape(row.n_rows, capacity)
    return {"input_ids": matrix(row.input_ids), "position_ids": matrix(row.position_ids), "cu_seqlens": row.cu_seqlens, "doc_ids": row.doc_ids, "starts": row.starts}
