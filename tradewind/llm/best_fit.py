"""Sequences of fixed size: best fit, longest first, with a segment tree over the room that open sequences have."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import release_memory, slices, stored
from tradewind.llm.tokens import encoder


class RoomTree:
    """Which amounts of room some open sequence has; `tightest(n)` is the least of them that holds n, in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)  # a node is set while any leaf below it is

    def set(self, room: int, present: bool) -> None:
        node = room + self.leaves
        self.open[node] = present
        node >>= 1
        while node:
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]
            node >>= 1

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:  # up until a right neighbour has something, then down to its first leaf
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of pieces given as {length: count}: (number of equal sequences, [(length, how many of it), ...]).

    The longest piece comes first, and each goes to the open sequence with the least room that holds it; where none
    does, a new one is opened. Pieces of a length are alike, and so are sequences with the same content, so they are
    placed together: the tightest sequence takes the next pieces too while it has room for them, as what is left
    of its room is tighter still. A length adds at most four kinds of sequences, so there are at most 4 x size kinds,
    each with at most sqrt(2 x size) different lengths, whatever the number of pieces.
    """
    rooms: list[list[tuple[int, tuple]]] = [[] for _ in range(size + 1)]
    tree = RoomTree(size)

    def put(room: int, count: int, content: tuple) -> None:
        if not rooms[room]:
            tree.set(room, True)
        rooms[room].append((count, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, count, content = size, None, ()
            else:
                count, content = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            filled = left // each if count is None else min(count, left // each)
            if filled:
                put(room - each * length, filled, ((length, each), content))
                left -= filled * each
            if count is None or count > filled:
                rest, last = None if count is None else count - filled, left if left < each else 0
                if last:  # fewer than one sequence takes
                    put(room - last * length, 1, ((length, last), content))
                    left, rest = 0, None if rest is None else rest - 1
                if rest:
                    put(room, rest, content)
    out = []
    for entries in rooms:
        for count, content in entries:
            lengths = []
            while content:
                entry, content = content
                lengths.append(entry)
            out.append((count, lengths[::-1]))
    return out


def _runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length the runs of ranks as rows: first rank, pieces per sequence, first sequence, offset of its first piece there."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length, each in lengths:
            runs.setdefault(length, []).append((used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + count * each
            offset += length * each
        sequence += count
    return {n: np.array(rows, np.int64).T.copy() for n, rows in runs.items()}


def encoded_pieces(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int, size: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ids and the end id, cut after every `size` ids: id, piece, start, length, ids_crc32, task, nth.

    `nth` numbers the pieces of a length within the task that made them.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"))
    names = ["piece", "start", "length", "ids_crc32", "task", "nth"]
    types = [T.IntegerType(), *[T.LongType()] * 5]
    schema = T.StructType([T.StructField("id", rows.schema[0].dataType), *map(T.StructField, names, types)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, seen = encoder(tokenizer, drops_space), TaskContext.get().partitionId(), [0] * (size + 1)
        for whole in batches:
            for batch in slices(whole, rows=4096, size=4 << 20):
                owners, found = [], []
                for row, ids in enumerate(tool.encode(batch.column(1))):
                    ids = np.append(ids, np.array(end_id, tool.dtype)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), size)):
                        part = ids[start:start + size]
                        owners.append(row)
                        found.append((piece, start, len(part), zlib.crc32(part), task, seen[len(part)]))
                        seen[len(part)] += 1
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(columns[0], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in columns[1:]]], schema.names)
        tool.forget()
        release_memory()

    return rows.mapInArrow(cut, schema)


def pack_best_fit(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int, size: int = 2048,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`; NULL counts as the empty text, which is the end id alone. Only documents
    longer than `size` are cut, after every `size` ids. Sequences hold at most `size` ids and have no gaps; they are
    numbered from 0. Pieces of a length are alike, so ties and repeated rows are packed one by one, and a NULL id
    is packed like any other. An empty table packs nothing. Only id and text are read, so further columns cannot
    clash.

    Texts are encoded once, by the tasks that read them, and do not move. Each task numbers its pieces by length; sums
    of the tasks' counts make ranks of these numbers, so no length is ever sorted or gathered, however common.
    The histogram of at most `size` rows goes to the driver and comes back as runs of ranks: at most
    4 x size x sqrt(2 x size) of 32 bytes, some 17 MB for 2048 ids, however many documents there are.
    """
    pieces = stored(encoded_pieces(docs, tokenizer, drops_space, end_id, size, id_col, text_col), "fit-pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "fit-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _runs(best_fit_decreasing(histogram, size))
    if sum(r.nbytes for r in runs.values()) > 4 * size * (2 * size) ** 0.5 * 32:
        raise AssertionError("more runs than best fit can make")
    shared = pieces.sparkSession.sparkContext.broadcast(runs)

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    schema = T.StructType([T.StructField(id_col, pieces.schema["id"].dataType), *pieces.schema.fields[1:5],
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                first, each, taken_by, at = by_length[length]
                run = np.searchsorted(first, ranks[rows], "right") - 1
                inside = ranks[rows] - first[run]
                sequence[rows] = taken_by[run] + inside // each[run]
                offset[rows] = at[run] + inside % each[run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(place, schema)
