"""Token ids in wavelet-matrix files: one compressed file per shard, read by position, value or occurrence."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import bound_batches, release_memory, slices
from tradewind.llm.tokens import encoder
from tradewind.session import work_folder

MAGIC = b"TWWM0001"
BLOCK_BITS = 1 << 16  # bits of a plane that are compressed together and counted by the rank directory
SHARD_TOKENS = 1 << 21  # a shard is closed by the document that reaches this
SLICE_BYTES = 4 << 20  # texts that are encoded together: a worker takes some 13 bytes for each of theirs

# File: MAGIC, header (tokens, planes, documents), document lengths, then per plane the number of zeros, the ones
# before each block (rank directory), the end of each compressed block, and the blocks. Integers are little-endian.
_HEADER = struct.Struct("<QIQ")


def _planes(ids: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Zeros and packed bits of each plane, top bit first; after each plane zeros go before ones, both in their order."""
    for level in range(bits - 1, -1, -1):
        packed = np.packbits((ids & np.array(1 << level).astype(ids.dtype)) != 0, bitorder="little")
        ones, values = pa.BooleanArray.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(packed)]), pa.array(ids)
        low, high = values.filter(pc.invert(ones)), values.filter(ones)
        yield len(low), packed
        ids = np.concatenate((low.to_numpy(), high.to_numpy()))


def write_shard(ids: np.ndarray, lengths: list[int], bits: int) -> bytes:
    """The file of one shard. `lengths`: tokens of each document."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = [MAGIC, _HEADER.pack(len(ids), bits, len(lengths)), np.array(lengths, "<u8").tobytes()]
    blocks = -(-len(ids) // BLOCK_BITS)
    for zeros, packed in _planes(ids, bits):
        starts = np.arange(0, len(packed), BLOCK_BITS // 8)
        counts = np.add.reduceat(np.bitwise_count(packed), starts, dtype=np.uint64) if blocks else np.zeros(0, np.uint64)
        parts = [squeeze(packed[i * BLOCK_BITS // 8:(i + 1) * BLOCK_BITS // 8].tobytes()) for i in range(blocks)]
        out += [struct.pack("<Q", zeros), np.concatenate(([0], np.cumsum(counts))).astype("<u8").tobytes(),
                np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes(), *parts]
    return b"".join(out)


class WaveletFile:
    """Reads a shard's file. Single queries unpack only the blocks they touch."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.data = memoryview(data)
        self.size, self.bits, documents = _HEADER.unpack_from(data, 8)
        at = 8 + _HEADER.size
        self.lengths = np.frombuffer(data, "<u8", documents, at)
        at += 8 * documents
        blocks = -(-self.size // BLOCK_BITS)
        self.planes = []
        for _ in range(self.bits):
            zeros = struct.unpack_from("<Q", data, at)[0]
            ranks = np.frombuffer(data, "<u8", blocks + 1, at + 8)
            ends = np.frombuffer(data, "<u8", blocks + 1, at + 8 + 8 * (blocks + 1))
            start = at + 8 + 16 * (blocks + 1)
            self.planes.append((zeros, ranks, ends, start))
            at = start + int(ends[-1])
        self._unpacked: dict[tuple[int, int], np.ndarray] = {}

    def __len__(self) -> int:
        return self.size

    def _block(self, plane: int, block: int, keep: bool = True) -> np.ndarray:
        if (plane, block) in self._unpacked:
            return self._unpacked[plane, block]
        _, _, ends, start = self.planes[plane]
        raw = zstandard.ZstdDecompressor().decompress(self.data[start + int(ends[block]):start + int(ends[block + 1])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK_BITS, self.size - block * BLOCK_BITS), bitorder="little")
        if keep:
            if len(self._unpacked) > 64:
                self._unpacked.clear()
            self._unpacked[plane, block] = bits
        return bits

    def _ones(self, plane: int, position: int) -> int:
        """Ones of the plane before the position."""
        block, rest = divmod(position, BLOCK_BITS)
        before = int(self.planes[plane][1][block])
        return before + int(self._block(plane, block)[:rest].sum()) if rest else before

    def access(self, position: int) -> int:
        """The id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, position // BLOCK_BITS)[position % BLOCK_BITS])
            ones = self._ones(plane, position)
            position = self.planes[plane][0] + ones if bit else position - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(self.bits):
            ones = self._ones(plane, start), self._ones(plane, end)
            if value >> (self.bits - 1 - plane) & 1:
                start, end = self.planes[plane][0] + ones[0], self.planes[plane][0] + ones[1]
            else:
                start, end = start - ones[0], end - ones[1]
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        if not 0 <= value < 1 << self.bits:
            return 0
        low, high = self._range(value, start, self.size if end is None else end)
        return high - low

    def rank(self, value: int, position: int) -> int:
        """Occurrences of an id before a position."""
        return self.count(value, 0, position)

    def _select_bit(self, plane: int, bit: int, number: int) -> int:
        """Position of the number-th (from 0) such bit of a plane."""
        ranks = self.planes[plane][1].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK_BITS, self.size) - ranks
        block = int(np.searchsorted(before, number, "right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[number - int(before[block])])

    def select(self, value: int, number: int) -> int:
        """Position of the number-th (from 0) occurrence of an id."""
        low, high = self._range(value, 0, self.size) if 0 <= value < 1 << self.bits else (0, 0)
        if not 0 <= number < high - low:
            raise IndexError(number)
        position = low + number
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            position = self._select_bit(plane, bit, position - self.planes[plane][0] if bit else position)
        return position

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.count(value))]

    def all_ids(self) -> np.ndarray:
        """Every id in order: the planes' stable partitions undone from the last to the first."""
        ids = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        blocks = len(self.planes[0][1]) - 1 if self.planes else 0
        for plane in range(self.bits - 1, -1, -1):
            if not blocks:
                break
            ones = np.concatenate([self._block(plane, b, keep=False) for b in range(blocks)]).view(bool)
            zeros, weight = self.planes[plane][0], ids.dtype.type(1 << (self.bits - 1 - plane))
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[:zeros]
            above[np.flatnonzero(ones)] = ids[zeros:] | weight
            ids = above
        return ids


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, end_id: int,
                       id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes whole texts and writes one file per shard below `path`, in ascending id order.

    NULL counts as the empty text; every document ends with `end_id`, so an empty one has that id alone. NULL
    ids come first; rows that repeat an id stand side by side. An empty table writes no shard. A shard is one
    Parquet file that holds one row: its place (`part`, `shard`), the ids of its documents (`docs`) and the
    wavelet matrix (`data`). Documents are dealt by range of (id, hash of the text), so that neither a part nor
    a repeated id meets in one task; a task holds the ids of one shard, however many it writes. At its end it empties
    the token caches, so that idle workers hold none.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part, shard = encoder(tokenizer, drops_space), TaskContext.get().partitionId(), 0
        bits = max(int(tool.tokenizer.get_vocab_size()) - 1, end_id, 1).bit_length()
        end = np.array([end_id], tool.dtype)
        held: list[np.ndarray] = []
        lengths: list[int] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            data = write_shard(np.concatenate(held), lengths, bits)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                   pa.array([sum(lengths)], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "docs", "tokens", "data"])

        for whole in batches:
            for batch in slices(whole, rows=16_384, size=SLICE_BYTES):
                for name, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1))):
                    held += [ids, end]
                    lengths.append(len(ids) + 1)
                    names.append(name)
                if sum(lengths) >= shard_tokens:
                    yield close()
                    held, lengths, names, shard = [], [], [], shard + 1
        if names:
            yield close()
        held, lengths, names = [], [], []
        tool.forget()
        release_memory()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(number, "id", F.xxhash64("text")).sortWithinPartitions("id")
    shards = placed.mapInArrow(encode, "part int, shard int, docs array<bigint>, tokens bigint, data binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Reads the files back: per document `doc_id`, `start`, `n_tokens`, `ids_crc32`, `part`, `shard`, `offset` in its shard.

    `start` counts the ids of all documents before it. Offsets of shards come from their counts: within a part
    by a window, across parts by one over a row per part.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, names, data in zip(*(batch.column(i) for i in range(4))):
                matrix = WaveletFile(data.as_py())
                ids = matrix.all_ids().astype("<u4")
                lengths = matrix.lengths.astype(np.int64)
                offsets = np.cumsum(lengths) - lengths
                sums = [zlib.crc32(ids[o:o + n]) for o, n in zip(offsets.tolist(), lengths.tolist())]
                count = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * count, pa.int32()), pa.array([shard.as_py()] * count, pa.int32()),
                     names.values, pa.array(offsets), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])
        release_memory()

    sizes = shards.select("part", "shard", "tokens")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(across), F.lit(0)).alias("before_part"))
    sizes = sizes.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("before_shard"))
    places = sizes.join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("before"))
    rows = shards.select("part", "shard", "docs", "data").mapInArrow(
        decode, "part int, shard int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(places, ["part", "shard"]).withColumn("start", F.col("before") + F.col("offset")).drop("before")


def token_shards(docs: DataFrame, tokenizer: str, drops_space: bool, end_id: int, path: str | None = None, **more) -> DataFrame:
    """Writes shards (to a new folder of the shared one unless `path` names another) and reads them back."""
    path = path or work_folder(docs.sparkSession, "token-shards")
    write_token_shards(docs, path, tokenizer, drops_space, end_id, **more)
    schema = "part int, shard int, docs array<bigint>, tokens bigint, data binary"
    return read_token_shards(docs.sparkSession.read.schema(schema).parquet(path))
