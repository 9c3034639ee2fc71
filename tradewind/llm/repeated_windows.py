"""Repeated byte windows: a depth-limited radix sort of suffixes, most significant digit first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import add_columns, bit_filter, hash128, slices, stored, with_filter, without
from tradewind.llm.hashing import mixed, powers

WINDOW = 400
GRAM = 128  # bytes of a window's first digit
BLOCKS = (36, 6, 1)  # window starts that a pass keeps together; each a multiple of the next, so that blocks nest
SEGMENT = 1 << 21  # windows of one text that are looked at together
DIGIT_BITS = 1 << 26  # bits of the set of repeated first digits: 8 MB on every executor, whatever the input
_CHUNK = 1 << 19


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    table = np.concatenate([values, np.full(-len(values) % width, values.max(initial=0), values.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(after[:count], before[width - 1:width - 1 + count])


def _segment_digits(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all windows of one stretch: place of the first digit, first and last window that it belongs to, the digit's hash."""
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mixed((sums[gram:] - sums[:-gram]) * inverse[:len(data) - gram + 1])
    # the leftmost of the grams whose hash begins lowest: the place in the stretch is only a tie-break
    keys = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    at = (_sliding_minimum(keys, window - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    return at[edge], edge, np.append(edge[1:], len(at)) - 1, hashes[at[edge]]


def first_digits(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: places of its windows' first digits, least and greatest offset of a window's start before it, hashes.

    A window's first digit is the gram inside it with the lowest hash, the leftmost of equals, so equal windows have
    equal first digits at equal offsets. Neighbouring windows mostly share theirs: a text has few.
    """
    data, parts = np.frombuffer(raw, np.uint8), []
    for start in range(0, len(data) - window + 1, SEGMENT):
        at, first, last, hashes = _segment_digits(data[start:start + SEGMENT + window - 1], window, gram)
        parts.append((at + start, at - last, at - first, hashes))
    if not parts:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, np.zeros(0, np.uint64)
    at, low, high, hashes = (np.concatenate(p) for p in zip(*parts))
    at, index = np.unique(at, return_index=True)  # stretches may share a place; a place keeps all its offsets
    ends = np.append(index[1:], len(low))
    if len(ends) == len(low):
        return at, low, high, hashes
    return at, np.minimum.reduceat(low, index), np.maximum.reduceat(high, index), hashes[index]


def _digest(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _block_rows(raw: bytes, at: int, low: int, high: int, base: int, size: int, widest: int, window: int):
    """(block's first offset, hash of the bytes all its windows share, of the bytes any has) of blocks that meet [low, high].

    `raw` begins at `base` of its text. The second hash is 0 where some window of the block is outside the text. At
    size 1 both are halves of a 128-bit hash of the window.
    """
    for first in range(low // size * size, high + 1, size):
        last = min(first + size - 1, widest)
        begin, end = at - last - base, at - first + window - base
        if size == 1:
            if begin >= 0 and end <= len(raw):
                both = xxhash.xxh3_128_intdigest(raw[begin:end])
                yield first, (both >> 64) - (1 << 63), ((both & (1 << 64) - 1) - (1 << 63)) or 1
        else:
            whole = begin >= 0 and end <= len(raw)
            yield first, _digest(raw[at - first - base:at - last + window - base]), (_digest(raw[begin:end]) or 1) if whole else 0


_ROW = ["at", "first", "core", "whole"]


def _verdicts(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose windows may repeat, with `same` (all windows of the block repeat) and `open` (the next digit decides).

    Open are the blocks that share a core but not their whole bytes; of blocks with the same whole bytes, which are
    decided, one place stays open as well, for the others to be compared with. Rows are grouped by their hashes
    first; the two joins bring back one row per group, so that a passage which a third of the texts share is a few
    rows before any key meets, and the adaptive joins split what is left.
    """
    key, place = ["first", "core", "whole"], F.struct("a", "b", "at")
    groups = stored(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("witness")), f"{name}-groups")
    cores = groups.groupBy("first", "core").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    cores = stored(cores.filter("n > 1").select("first", "core", "kinds"), f"{name}-cores")
    kept = groups.join(cores, ["first", "core"]).withColumn("same", (F.col("n") > 1) & (F.col("whole") != 0))
    kept = kept.select(*key, "same", F.when(F.col("same") & (F.col("kinds") > 1), F.col("witness")).alias("witness"))
    judged = rows.join(stored(kept, f"{name}-verdicts"), key)
    return judged.withColumn("open", ~F.col("same") | F.coalesce(F.col("witness") == place, F.lit(False))).drop("witness")


def _repeated_digits(texts: DataFrame, window: int, gram: int) -> bytes:
    """Bit set of the first digits that occur twice or more."""
    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                for raw in batch.column(0).to_pylist():
                    found = first_digits(raw.encode("utf-8", "surrogatepass"), window, gram)[3]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["digit"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy()
            chunk = slot // _CHUNK
            for c in np.unique(chunk).tolist():
                sets.setdefault(c, np.zeros(_CHUNK, bool))[slot[chunk == c] % _CHUNK] = True
        for c, found in sets.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(found).tobytes()], pa.binary())], ["chunk", "bits"])

    twice = texts.select("_text").mapInArrow(digits, "digit bigint").groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1")
    slot = twice.select(F.pmod("digit", F.lit(DIGIT_BITS)).alias("slot"))
    dealt = slot.repartition(32, F.expr(f"slot div {_CHUNK}")).mapInArrow(bits, "chunk bigint, bits binary")
    out = np.zeros(DIGIT_BITS // 8, np.uint8)
    for row in dealt.collect():  # one row per chunk of the set
        out[row.chunk * _CHUNK // 8:(row.chunk + 1) * _CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _first_pass(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Block rows of all windows whose first digit may repeat."""
    shared = texts.sparkSession.sparkContext.broadcast(_repeated_digits(texts, window, gram))
    size = BLOCKS[0]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for batch in slices(whole):
                out = []
                for a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    at, low, high, hashes = first_digits(raw, window, gram)
                    slot = np.mod(hashes.view(np.int64), DIGIT_BITS)
                    may = (known[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
                    for p, l, h in zip(at[may].tolist(), low[may].tolist(), high[may].tolist()):
                        out += [(a, b, p, *row) for row in _block_rows(raw, p, l, h, 0, size, window - gram, window)]
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", *_ROW])

    rows = texts.select("_t.a", "_t.b", "_text").mapInArrow(blocks, "a bigint, b bigint, at bigint, first bigint, core bigint, whole bigint")
    return rows.select("a", "b", F.col("at").cast("int"), F.col("first").cast("int"), "core", "whole")


_HASHED = "array<struct<first: int, core: bigint, whole: bigint>>"
_HASHED_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("core", pa.int64()), ("whole", pa.int64())]))


def _split_rows(raw: bytes, base: int, length: int, at: int, firsts: list[int], old: int, new: int, widest: int, window: int) -> list[dict]:
    """Blocks of `new` windows within blocks of `old` that begin at `firsts`, where the text of that length has windows."""
    out = []
    for first in firsts:
        low, high = max(first, at + window - length), min(first + old - 1, widest, at)
        if low <= high:
            out += [dict(zip(_ROW[1:], row)) for row in _block_rows(raw, at, low, high, base, new, widest, window)]
    return out


def _runs(same: DataFrame, size: int, window: int, gram: int) -> DataFrame:
    """Bytes [begin, end) of the repeated windows of whole blocks."""
    last = F.least(F.col("first") + size - 1, F.lit(window - gram))
    return same.select("a", "b", (F.col("at") - last).alias("begin"), (F.col("at") - F.col("first") + window).alias("end"))


def _contexts(texts: DataFrame, split: DataFrame, window: int, gram: int) -> DataFrame:
    """Of texts with undecided blocks: the bytes around each digit and the hashes of the second pass."""
    wanted = stored(split.groupBy("a", "b").agg(F.collect_set(F.struct("at", "first")).alias("places")), "window-open")
    words = stored(bit_filter(wanted.select("a")), "window-open-filter")
    some = with_filter(texts, words, F.col("_t.a"), "_may").filter("_may").select("_t.a", "_t.b", "_text")
    rows = some.join(wanted, ["a", "b"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = []
                for a, b, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    for place in places:
                        at, first = place["at"], place["first"]
                        base, end = max(0, at - first - BLOCKS[0] + 1), min(len(raw), at - first + window)
                        hashed = _split_rows(raw[base:end], base, len(raw), at, [first], *BLOCKS[:2], window - gram, window)
                        out.append((a, b, at, base, len(raw), raw[base:end], hashed))
                columns = list(zip(*out)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), _HASHED_ARROW]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "at", "base", "size", "bytes", "hashed"])

    found = rows.select("a", "b", "_text", "places").mapInArrow(
        cut, f"a bigint, b bigint, at int, base int, size int, bytes binary, hashed {_HASHED}")
    return stored(found.withColumn("x", F.monotonically_increasing_id()), "window-contexts")


def _last_pass(contexts: DataFrame, undecided: DataFrame, window: int, gram: int) -> DataFrame:
    """Single windows of the blocks that the second pass left undecided."""
    rows = contexts.drop("hashed").join(undecided.groupBy("x").agg(F.collect_set("first").alias("firsts")), "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, at, base, size, raw, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                split = _split_rows(raw, base, size, at, firsts, *BLOCKS[1:], window - gram, window)
                out += [(a, b, at, r["first"], r["core"], r["whole"]) for r in split]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", *_ROW])

    found = rows.select("a", "b", "at", "base", "size", "bytes", "firsts").mapInArrow(
        cut, "a bigint, b bigint, at bigint, first bigint, core bigint, whole bigint")
    return found.select("a", "b", F.col("at").cast("int"), F.col("first").cast("int"), "core", "whole")


def repeated_runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Per text hash (a, b) the byte ranges that repeated windows cover: `runs`, not yet merged."""
    rows = stored(_first_pass(texts, window, gram), "window-first")
    judged = stored(_verdicts(rows, "window-first").select("a", "b", "at", "first", "same", "open"), "window-judged")
    contexts = _contexts(texts, judged.filter("open"), window, gram)

    rows = contexts.select("x", "a", "b", "at", F.explode("hashed").alias("h")).select("x", "a", "b", "at", "h.*")
    second = stored(_verdicts(rows, "window-second").select("x", "a", "b", "at", "first", "same", "open"), "window-second")
    rows = stored(_last_pass(contexts, second.filter("open"), window, gram), "window-last")
    third = _verdicts(rows, "window-last").filter("same")

    found = _runs(judged.filter("same"), BLOCKS[0], window, gram)
    found = found.unionByName(_runs(second.filter("same"), BLOCKS[1], window, gram)).unionByName(_runs(third, BLOCKS[2], window, gram))
    return stored(found.groupBy("a", "b").agg(F.collect_set(F.struct("begin", "end")).alias("runs")), "window-runs")


def _merged(runs: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in runs or []):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def drop_repeated_windows(df: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The input with `n_bytes`, `n_removed`, `n_spans`, `removed_spans` (begin, end) and `kept_bytes`.

    Texts are UTF-8 bytes, NULL and '' none. Every byte that a string of `window` bytes covers which also starts
    anywhere else (in this text, in another row, in a repeated row) is removed; strings are judged on the input.
    What is left is bytes, as a cut may fall into a character. Texts shorter than the window are never cut. Empty
    tables give an empty result; input columns named like a result are replaced.

    Suffixes are ordered only through `window` bytes and only as far as they tie. The first digit of a window is the
    lowest-hashed gram inside it, which about a hundred neighbouring windows share; windows whose first digit occurs
    once are alone and drop out. The others go through passes of ever smaller blocks of neighbouring windows: blocks
    whose common bytes are unique drop out, blocks whose whole bytes repeat are decided together, the rest is split.
    In the last pass blocks are single windows, and equal groups are exactly the repeated windows, by a 128-bit hash.
    """
    added = ["n_bytes", "n_removed", "n_spans", "removed_spans", "kept_bytes"]
    df = without(df, added)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = df.select(hash128(text).alias("_t"), text.alias("_text"))
    runs = repeated_runs(texts.filter(F.octet_length("_text") >= window), window, gram)

    words = stored(bit_filter(runs.select("a")), "window-runs-filter")
    rows = with_filter(df.withColumn("_t", hash128(text)), words, F.col("_t.a"), "_may")
    # texts that certainly keep all their bytes need not meet the runs
    whole = rows.filter("not _may").drop("_may", "_t")
    runs = runs.select(F.struct("a", "b").alias("_t"), F.col("runs").alias("_runs"))
    meet = rows.filter("_may").join(runs, "_t", "left").drop("_may", "_t")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("removed_spans", span), T.StructField("kept_bytes", T.BinaryType())]

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        spans, kept = [], []
        for value, found in zip(column(text_col), column("_runs")):
            raw, merged, left, at = (value or "").encode("utf-8", "surrogatepass"), _merged(found), [], 0
            for begin, end in merged:
                left.append(raw[at:begin])
                at = end
            spans.append([{"begin": b, "end": e} for b, e in merged])
            kept.append(b"".join([*left, raw[at:]]))
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return [pa.array(spans, kind), pa.array(kept, pa.binary())]

    meet = add_columns(meet, fields, cut).drop("_runs")
    whole = whole.withColumns({"removed_spans": F.array().cast(span), "kept_bytes": F.encode(text, "UTF-8")})
    out = meet.unionByName(whole)
    size: Column = F.octet_length(text).cast("long")
    out = out.withColumns({"n_bytes": size, "n_removed": size - F.octet_length("kept_bytes"), "n_spans": F.size("removed_spans").cast("long")})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *added)
