"""What the operators share: tables in the shared folder, row-wise Arrow steps, word splitting."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.session import work_folder

# Fixed value: the bytes that separate words once A-Z are lower-cased.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(range(256))
for _code in range(ord("A"), ord("Z") + 1):
    _FOLD[_code] = _code + 32
for _code in _SEPARATORS:
    if not ord("A") <= _code <= ord("Z"):
        _FOLD[_code] = ord(" ")
_FOLD = bytes(_FOLD)
WORD_BYTES = np.frombuffer(_FOLD, np.uint8) != ord(" ")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; every byte of a non-ASCII character is a word byte."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def stored(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops input columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


# Texts go to Python in batches of so many bytes (or one row): a number of rows says nothing about their size.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's batches by BATCH_BYTES; the session keeps that, since what is built on it is lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a worker holds few texts at a time: at most `rows` rows, and `size` bytes or one row."""
    start = 0
    weights = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            weights += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(weights)
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        fit = int(np.searchsorted(ends, before + size, "right")) - start
        count = max(1, min(rows, fit, batch.num_rows - start))
        yield batch.slice(start, count)
        start += count


def add_columns(df: DataFrame, fields: list[T.StructField], step: Callable[[pa.RecordBatch], list[pa.Array]],
                size: int = 1 << 20) -> DataFrame:
    """Row-wise step over Arrow batches that keeps the input columns and adds `fields`.

    `step(batch)` gets `slices` of that size and returns one array per field. Input columns with a name of `fields` are replaced.
    """
    kept = without(df, [f.name for f in fields])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, size=size):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *step(batch)], [*batch.schema.names, *[f.name for f in fields]])
        release_memory()

    return kept.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Rows that are sorted by their first `keys` columns, all of them numbers, one group after the other.

    A task thus holds one group and one batch, however large the groups before and after it are.
    """
    held: list[pa.RecordBatch] = []
    current: tuple[int, ...] = ()
    for batch in batches:
        values = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        starts = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]).any(axis=1)))) if len(values) else []
        for start, end in zip(starts, [*starts[1:], len(values)]):
            key = tuple(values[start].tolist())
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)


def release_memory() -> None:
    """Gives what a worker process no longer uses back to the system: idle workers otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def hash128(column: Column) -> Column:
    """128-bit identity of a string as a struct of two longs: two seeds of one 64-bit hash.

    The second hash starts from the first one's seed column, so that the two are independent.
    """
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit("salt"), column).alias("b"))


# A bit filter has FILTER_WORDS x 64 bits: 1 MB on every executor, whatever the input.
FILTER_WORDS = 1 << 17


def bit_filter(hashes: DataFrame) -> DataFrame:
    """The one long column of `hashes` as one row: a bit set of fixed size, made with a partial aggregation."""
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_WORDS * 64))
    bits = hashes.select(slot.alias("slot")).select(
        F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bits"))
    zeros = hashes.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    filled = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("set"))
    return filled.select(F.col("set.bits").alias("_words"))


def with_filter(df: DataFrame, words: DataFrame, hashed: Column, name: str) -> DataFrame:
    """Adds whether a row's hash may be in the filter: never false for one that is."""
    slot = df.withColumn("_slot", F.pmod(hashed, F.lit(FILTER_WORDS * 64)))
    word = slot.withColumn("_word", F.element_at(words.scalar(), F.expr("cast(_slot div 64 as int) + 1")))
    return word.withColumn(name, F.expr("shiftright(_word, cast(_slot % 64 as int)) & 1L") == 1).drop("_slot", "_word")
