"""Sequences of fixed size: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import release_memory, slices, stored
from tradewind.llm.tokens import encoder

CUT_UNIT = 0  # what remains of a document after full sequences stays whole; above 0 it is cut at a multiple of this
BLOCK_ROWS = 65_536  # pieces whose ranks one window counts


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns as (how many sequences, their lengths in order) for pieces given as {length: count}.

    Lengths go from the longest to the shortest, each into the packs that are shortest so far: those with most
    room. Packs with the same content are one entry with a count, which splits when a length runs out, so the
    work follows the number of distinct lengths and not of pieces.
    """
    room: list[list[tuple[int, tuple]]] = [[] for _ in range(size + 1)]
    most = -1
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        most = size  # packs with most room first; entries only ever move to less room
        while left:
            while most >= length and not room[most]:
                most -= 1
            if most < length:
                # the next piece would go to the pack opened for this one until that is full
                each = min(size // length, left)
                count, content, free = left // each, (), size - (each - 1) * length
                for _ in range(each - 1):
                    content = (length, content)
                left -= count * (each - 1)
            else:
                (count, content), free = room[most].pop(), most
                if count > left:
                    room[free].append((count - left, content))
                    count = left
            left -= count
            room[free - length].append((count, (length, content)))
            most = max(most, free - length)
    out = []
    for entries in room:
        for count, content in entries:
            lengths = []
            while content:
                lengths.append(content[0])
                content = content[1]
            out.append((count, lengths[::-1]))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each run of ranks, the sequence that takes it, the offset there.

    Rank r of a run goes to the run's sequence plus r less the run's first rank.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return {n: tuple(np.array(column, np.int64) for column in zip(*rows)) for n, rows in runs.items()}


def _cuts(tokens: int, size: int, unit: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then the largest multiple of the unit, then the rest."""
    rest = tokens % size
    middle = rest - rest % unit if unit else rest
    return [*[size] * (tokens // size), *[n for n in (middle, rest - middle) if n]]


def cut_documents(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int, size: int = 2048, unit: int = CUT_UNIT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the encoded documents: doc_id, start, length, ids_crc32, doc_tokens."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, drops_space)
        for whole in batches:
            for batch in slices(whole, rows=4096, size=4 << 20):
                rows = []
                for name, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1))):
                    ids = np.append(ids, np.array(end_id, tool.dtype)).astype("<u4")
                    at = 0
                    for n in _cuts(len(ids), size, unit):
                        rows.append((name, at, n, zlib.crc32(ids[at:at + n]), len(ids)))
                        at += n
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tool.forget()
        release_memory()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int, size: int = 2048, unit: int = CUT_UNIT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and `end_id`; NULL counts as the empty text, which is the end id alone. Documents longer
    than `size` fill whole sequences; what remains is cut once, at the largest multiple of `unit` (0: not at all).
    Every id lies in one piece, sequences hold at most `size` ids without gaps, and a piece of a given length is
    like any other of that length, so ties and repeated rows are packed one by one. An empty table packs nothing.
    Input columns but id and text are not read.

    Texts are encoded once. Of the pieces only the histogram goes to the driver, at most `size` rows. Ranks of
    equal lengths come from counts per (length, block of rows): a length that a third of the pieces have is
    numbered block by block. The patterns go back as runs of ranks: at most one per pattern and length.
    """
    pieces = cut_documents(docs, tokenizer, drops_space, end_id, size, unit, id_col, text_col)
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    pieces = pieces.withColumn("_block", F.expr(f"_row div {BLOCK_ROWS}"))
    counts = stored(pieces.groupBy("length", "_block").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(shortest_pack_first(histogram, size)))

    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy("_row")
    ranked = (pieces.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_block"])
              .withColumn("_rank", F.col("_before") + F.col("_in")).drop("_before", "_in", "_block", "_row"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = slots.value
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                first, taken_by, at = runs[length]
                run = np.searchsorted(first, ranks[rows], "right") - 1
                sequence[rows] = taken_by[run] + ranks[rows] - first[run]
                offset[rows] = at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             [*names[:5], "sequence_id", "offset"])

    return ranked.select(*names).mapInArrow(
        place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str, drops_space: bool, end_id: int,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed ids: sequence_id, ids, and the ends of its pieces. Document ids must be unique and not NULL."""
    cut = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cut"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(cut, "doc_id")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, drops_space)
        for whole in batches:
            for batch in slices(whole, rows=4096, size=4 << 20):
                rows = []
                for ids, cuts in zip(tool.encode(batch.column(0)), batch.column(1).to_pylist()):
                    ids = [*ids.tolist(), end_id]
                    rows += [(c["sequence_id"], c["offset"], ids[c["start"]:c["start"] + c["length"]]) for c in cuts]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))],
                    ["sequence_id", "offset", "ids"])
        tool.forget()
        release_memory()

    parts = rows.select("text", "cut").mapInArrow(fill, "sequence_id bigint, offset bigint, ids array<int>")
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.flatten("p.ids").alias("ids"),
                          F.transform("p", lambda x: (x["offset"] + F.size(x["ids"])).cast("int")).alias("piece_ends"))
