"""The prefix trie of conversations by an LCP-aware merge sort.

A conversation is the sequence of its turns in order (null first, ties by the SHA-256 of their content); null roles and texts are empty. With
`shared`, conversation c begins with the first h turns of conversation c - c mod 5 (h = crc32 of c's decimals mod 9; all
if that one has fewer, none if it does not exist), and goes on with its own turns after the first h. Every distinct
sequence of the first d turns of a conversation is a node of depth d.

1. A turn is reduced to 128 bits of a SHA-256 of role and text, and the bytes of its text. Equal conversations are
   counted as one sequence from here on, so a conversation that very many share is one row.
2. Each task sorts the sequences it reads in runs; every sequence carries the length of the prefix that it has in common
   with the one before it in its run (LCP). Spark deals the runs out by ranges of sequences; the number of ranges grows
   with the data, so that a range fits into a task.
3. In a range a loser tree merges the runs: of two sequences the one with the longer prefix in common with the last
   output is smaller, and only where both are equally long are turns compared, from that turn on. The merged sequences
   come with their LCPs; the turns of a sequence beyond its LCP open new nodes on a stack, and nodes deeper than the next
   LCP are finished. Their figures go up to their parents.
4. A node can reach over several ranges, if it lies on the path of a range's first or last sequence and is no deeper than
   what this has in common with the neighbour's (the driver gets the first and last sequence of every range, no more).
   Such nodes are added up over the ranges, the first of which counts what each node has once.

Result: one row per node with `conv_id`, the smallest conversation through it, `depth`, `parent_conv_id`, `n_convs`,
`n_children`, `n_leaves` (childless nodes of its subtree, itself included), `saved_tokens` (over its subtree the sum of
(n_convs - 1) times the bytes of the node's last text) and `ends_sha256` (of the decimal ids that end at the node,
ascending, joined by commas).

Defined cases: rows without a conversation id are left out; repeated rows are turns of their own; the remainder of a negative id is
not negative; conversations without turns end at the root; no conversations: no rows; further columns are not read. A
sequence is one value, so a conversation may have up to about 10^8 turns.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import broadcast_if_small, discard, materialize, n_partitions
from cadenza.llm.tokens import released

#: Bytes of a turn in a sequence.
TURN = 16
#: Bytes of sequences in one range, on average.
RANGE_BYTES = 4 << 20
#: Ids that are joined to one text before the texts of a node are hashed.
PACK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
FIGURES = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(conversations: DataFrame, shared: bool = True) -> DataFrame:
    """(conv, seq, lens): each conversation as the joined hashes of its turns and the bytes of their texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", key.alias("key"), F.octet_length(text).cast("bigint").alias("n")
    )
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "n"))).alias("turns"))
    if shared:
        own = materialize(own, "turns")
        heads = own.where(F.pmod("conv", F.lit(5)) == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, 8).alias("head"))
        own = own.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(5)))
        joined = own.join(heads, "base", "left")
        head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<turn:bigint,key:string,n:bigint>>")), F.lit(1), F.col("h")))
        head = F.coalesce(head, F.array().cast("array<struct<turn:bigint,key:string,n:bigint>>"))
        own = joined.select("conv", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    return own.select("conv", seq.alias("seq"), F.transform("turns", lambda t: t["n"]).alias("lens"))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end, first, ids): the ids of an end, in order, joined by commas, up to PACK in one text."""
    end, ids = None, []
    for batch in batches:
        rows = []
        for e, conv in zip(batch.column("end").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (e != end or len(ids) == PACK):
                rows.append((end, ids[0], ",".join(map(str, ids))))
                ids = []
            end = e
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["end", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([end]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["end", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end, ends_sha256) from the texts of every end in order."""
    end, digest = None, None
    for batch in batches:
        rows = []
        for e, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if e != end:
                if digest is not None:
                    rows.append((end, digest.hexdigest()))
                end, digest = e, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["end", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end]), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """(seq, lens, n, conv, ends): the distinct sequences of (conv, seq, lens) with their number, least id and hash of ids."""
    parts = n_partitions(rows.sparkSession)
    rows = materialize(rows.withColumn("end", F.sha2("seq", 256)), "sequences")
    classes = rows.groupBy("seq", "lens", "end").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    classes = materialize(classes, "distinct")
    members = rows.select("end", "conv").join(classes.where("n > 1").select("end"), "end")
    packs = members.repartitionByRange(parts, "end", "conv").sortWithinPartitions("end", "conv").mapInArrow(_packs, "end string, first bigint, ids string")
    ends = packs.repartition(parts, "end").sortWithinPartitions("end", "first").mapInArrow(_hashed, "end string, ends_sha256 string")
    out = classes.join(ends, "end", "left")
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    return out.select("seq", "lens", "n", "conv", F.coalesce("ends_sha256", alone).alias("ends"))


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Number of turns that both begin with, `known` of which need no comparison."""
    at, most = known * TURN, min(len(a), len(b))
    while at < most and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a sorted run: rows with `run`, `ord` and `lcp`, the turns in common with the row before."""
    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        seqs = batch.column("seq").to_pylist()
        order = sorted(range(len(seqs)), key=seqs.__getitem__)
        lcp = [0, *(common_turns(seqs[a], seqs[b]) for a, b in zip(order, order[1:], strict=False))][: len(order)]
        n = len(order)
        added = [pa.array([run] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(lcp, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(order, pa.int64())).columns, *added], names=[*batch.schema.names, "run", "ord", "lcp"])
        run += 1


def merge(seqs: list[bytes], lcps: list[int], runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(row, LCP with the row before it) of all rows in order, by a loser tree over `runs` (from, until) of sorted rows.

    A contender's LCP is that with the last output, which every loser on the winner's way has lost to.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [a for a, _ in runs] + [0] * (k - len(runs))
    end = [b for _, b in runs] + [0] * (k - len(runs))
    have = [0] * k

    def play(p: int, q: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP becomes that with the winner where turns were compared."""
        if at[q] >= end[q]:
            return p, q
        if at[p] >= end[p]:
            return q, p
        if have[p] != have[q]:
            return (p, q) if have[p] > have[q] else (q, p)
        a, b = seqs[at[p]], seqs[at[q]]
        same = common_turns(a, b, have[p])
        p, q = (p, q) if a[same * TURN : (same + 1) * TURN] <= b[same * TURN : (same + 1) * TURN] else (q, p)
        have[q] = same
        return p, q

    losers, winners = [0] * k, [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if k > 1 else 0
    while at[winner] < end[winner]:
        yield at[winner], have[winner]
        at[winner] += 1
        have[winner] = lcps[at[winner]] if at[winner] < end[winner] else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class _Nodes:
    """The nodes of one range in the order in which they opened; those that neighbours share are marked."""

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after  # turns in common with the neighbour's sequence; -1 without one
        self.columns = {c: array("q") for c in ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_bytes")}
        self.ends: dict[int, str] = {}
        self.shared: dict[int, bytes] = {}
        self.open: list[int] = []
        self.first: list[bool] = []  # whether an open node lies on the range's first path

    def _push(self, depth: int, n_bytes: int, first: bool) -> None:
        c = self.columns
        for name, value in (("conv_id", 2**63 - 1), ("depth", depth), ("parent", self.open[-1] if self.open else -1), ("n_convs", 0), ("n_children", 0), ("n_leaves", 0), ("saved_tokens", 0), ("n_bytes", n_bytes)):
            c[name].append(value)
        self.open.append(len(c["depth"]) - 1)
        self.first.append(first)

    def _pop(self, seq: bytes, last: bool) -> None:
        """The deepest open node is finished; `seq` goes through it, `last`: it is on the range's last path."""
        c, node, first = self.columns, self.open.pop(), self.first.pop()
        depth, parent = c["depth"][node], c["parent"][node]
        begun = first and depth <= self.before  # an earlier range counts this node
        goes_on = last and depth <= self.after
        if begun or goes_on:
            self.shared[node] = seq[: depth * TURN]
        if not c["n_children"][node] and not goes_on and node in self.ends:
            c["n_leaves"][node] = 1
        c["saved_tokens"][node] += (c["n_convs"][node] - (not begun)) * c["n_bytes"][node]
        if parent >= 0:
            for name in ("n_convs", "n_leaves", "saved_tokens"):
                c[name][parent] += c[name][node]
            c["n_children"][parent] += not begun
            c["conv_id"][parent] = min(c["conv_id"][parent], c["conv_id"][node])

    def add(self, merged: Iterator[tuple[int, int]], seqs: list[bytes], lens: list[list[int]], n: list[int], conv: list[int], ends: list[str]) -> None:
        c, before = self.columns, b""
        self._push(0, 0, True)
        for at, (row, lcp) in enumerate(merged):
            while len(self.open) > lcp + 1:
                self._pop(before, False)
            for depth in range(lcp + 1, len(lens[row]) + 1):
                self._push(depth, lens[row][depth - 1], not at)
            top, before = self.open[-1], seqs[row]
            c["n_convs"][top] += n[row]
            c["conv_id"][top] = min(c["conv_id"][top], conv[row])
            self.ends[top] = ends[row]
        while self.open:
            self._pop(before, True)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(key, parent_key, figures ...): `key` only of shared nodes, `parent_key` of these and of their children."""
        c = self.columns
        keys = {node: hashlib.blake2b(prefix, digest_size=16).digest() for node, prefix in self.shared.items()}
        total = len(c["depth"])
        for a in range(0, total, 1 << 16):
            nodes = range(a, min(a + (1 << 16), total))
            parents = [c["parent"][i] for i in nodes]
            figures = {f: pa.array(c[f][nodes.start : nodes.stop], pa.int64()) for f in FIGURES[:-1]}
            columns = {
                "key": pa.array([keys.get(i) for i in nodes], pa.binary()),
                "parent_key": pa.array([keys.get(p) for p in parents], pa.binary()),
                "parent_conv_id": pa.array([None if p < 0 or p in keys else c["conv_id"][p] for p in parents], pa.int64()),
                **figures,
                "ends_sha256": pa.array([self.ends.get(i) for i in nodes], pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _range_nodes(shared: dict[int, tuple[int, int]]):
    """The nodes of every range, from its runs in order (`part`, `run`, `ord`)."""

    def finish(part: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        run, seqs, lcps = (table.column(c).to_pylist() for c in ("run", "seq", "lcp"))
        cuts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
        nodes = _Nodes(*shared[part])
        nodes.add(merge(seqs, lcps, list(zip(cuts, cuts[1:], strict=False))), seqs, *(table.column(c).to_pylist() for c in ("lens", "n", "conv", "ends")))
        yield from nodes.batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            parts = batch.column("part").to_pylist()
            cuts = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and parts[a] != now:
                    yield from finish(now, held)
                    held = []
                now = parts[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(now, held)

    return task


def _neighbours(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """part -> turns that its first sequence has in common with the range before, and its last with the range after (-1: none)."""
    rows = ranges.groupBy("part").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("part").collect()
    both = [common_turns(bytes(x["b"]), bytes(y["a"])) for x, y in zip(rows, rows[1:], strict=False)]
    return {r["part"]: (l, n) for r, l, n in zip(rows, [-1, *both], [*both, -1], strict=False)}


def trie(conversations: DataFrame, shared: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per node, as the module says, from (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    classes = distinct_sequences(sequences(conversations.select("conv_id", "turn", "role", "text"), shared))
    schema = "seq binary, lens array<bigint>, n bigint, conv bigint, ends string"
    runs = materialize(classes.mapInArrow(released(_runs), f"{schema}, run bigint, ord bigint, lcp bigint"), "runs")
    total = runs.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()[0]
    parts = max(n_partitions(spark), -(-total // range_bytes))
    ranges = materialize(runs.repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id()), "ranges")
    discard(runs)
    rows = ranges.repartition(parts, "part").sortWithinPartitions("part", "run", "ord")
    figures = "parent_conv_id bigint, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    nodes = materialize(rows.mapInArrow(released(_range_nodes(_neighbours(ranges))), f"key binary, parent_key binary, {figures}"), "nodes")
    discard(ranges)

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    over = nodes.where("key IS NOT NULL").groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    over = materialize(over, "shared-nodes")
    own = nodes.where("key IS NULL")
    below = own.where("parent_key IS NOT NULL").select("parent_key", *FIGURES).unionByName(over.select("parent_key", *FIGURES))
    parents = broadcast_if_small(over.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    below = below.join(parents, "parent_key", "left")
    out = own.where("parent_key IS NULL").select(*FIGURES, "parent_conv_id").unionByName(below.select(*FIGURES, "parent_conv_id"))
    return out.select("conv_id", "depth", "parent_conv_id", *FIGURES[2:-1], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
