"""Jaccard join on word shingles: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import bit_filter, hash128, release_memory, slices, sorted_groups, stored, with_filter
from tradewind.llm.components import components
from tradewind.llm.hashing import mixed, shingles, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band once in 2e7
HASHES = BANDS * ROWS
STEP = 16  # hashes compared between two prunings
TOLERANCE = 1e-6  # a pair is dropped when its posterior chance of reaching the threshold is below
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 250_000  # of one bucket that are compared and verified in one go
SLICE_BYTES = 1 << 18  # of text at once; its hashes take some 40 times as much

_random = np.random.default_rng(20240607)
_FACTOR = (_random.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each of the MinHash values."""
    values = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 1024):
        np.minimum(least, (values[start:start + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return (mixed(least.astype(np.uint64)) >> np.uint64(48)).astype("<u2")


def bucket_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its values, mixed with the band's number."""
    return mixed(sign.view("<u8") ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP hashes, the fewest matches with which a pair may still reach the threshold.

    With a uniform prior, m matches of n leave the similarity a Beta(m + 1, n - m + 1) posterior; its weight above
    t is the chance that a binomial of n + 1 draws with success t stays at m or below.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def plausible_pairs(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Index pairs (of rows of the two signature tables) that survive every pruning."""
    a, b = np.divmod(np.arange(len(left) * len(right)), len(right))
    matches = np.zeros(len(a), np.int16)
    for i, enough in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches += (left[a, part] == right[b, part]).sum(axis=1, dtype=np.int16)
        stay = matches >= enough
        a, b, matches = a[stay], b[stay], matches[stay]
    return np.column_stack([a, b])


def _forest(count: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, without circles."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((a, b))
    return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets, as products of 0/1 matrices over slices of what they hold."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = often[column] > 1
    owner, column = owner[useful], column[useful]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, (8 << 20) // len(sets)))
    total = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, columns, width):
        part = slice(*np.searchsorted(column, [start, start + width]))
        table = np.zeros((len(sets), width), np.float32)
        table[owner[part], column[part] - start] = 1
        total += np.rint(table[left] @ table[right].T).astype(np.int64)
    return total


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each left set reaches the threshold with each right set; exact."""
    limit = Fraction(str(threshold))
    sizes = np.array([len(s) for s in sets], np.int64)
    both = _shared(sets, left, right)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (both * limit.denominator >= union * limit.numerator) & (both > 0)


def _in_blocks(df: DataFrame) -> DataFrame:
    """Deals the members of a bucket into its `blocks`, and each block to all pairs of blocks it is in: `part`, `i`, `j`.

    Rows come out sorted by (bucket, i, j), each such group in one task.
    """
    part = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = df.withColumn("part", part).withColumn("_other", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    dealt = dealt.withColumn("i", F.least("part", "_other")).withColumn("j", F.greatest("part", "_other"))
    return dealt.drop("blocks", "_other")


def _by_block_pair(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("bucket", "i", "j", *columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


class _Members:
    """The members of two blocks of a bucket that are compared with each other."""

    def __init__(self, key: tuple[int, ...], rows: pa.Table):
        _, self.i, self.j = key
        self.keys = rows.column("key").to_pylist()
        self.parts = rows.column("part").to_numpy()
        self.band = int(rows.column("band")[0].as_py())
        signs = b"".join(rows.column("sign").to_pylist())
        self.signs = np.frombuffer(signs, "<u2").reshape(-1, HASHES)
        self.bands = np.frombuffer(signs, "<u8").reshape(-1, BANDS)
        self.kept = (rows.column("mask").to_numpy()[:, None] >> np.arange(BANDS)) & 1 > 0

    def pairs(self, least: list[int]) -> np.ndarray:
        """Pairs that survive the pruning and are this bucket's to verify: the first that both ends are in."""
        left, right = np.flatnonzero(self.parts == self.i), np.flatnonzero(self.parts == self.j)
        found = plausible_pairs(self.signs[left], self.signs[right], least)
        a, b = left[found[:, 0]], right[found[:, 1]]
        if self.i == self.j:
            a, b = a[a < b], b[a < b]
        first = ((self.bands[a] == self.bands[b]) & self.kept[a]).argmax(axis=1)
        return np.column_stack([a, b])[first == self.band]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text, hash of its shingle set (NULL without words), shingles, signature, bucket keys."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, size=SLICE_BYTES):
                keys, counts, signs, buckets = [], [], [], []
                for words in word_hashes(batch.column(2).to_pylist()):
                    found = shingles(words, SHINGLE)
                    counts.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sign = signature(found)
                    signs.append(sign.tobytes() if len(found) else None)
                    buckets.append(bucket_keys(sign) if len(found) else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                     pa.array(signs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                    ["id", "t", "key", "n", "sign", "buckets"])
        release_memory()

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), hash128(text).alias("t"), text.alias("text"))
    return rows.mapInArrow(sketch, "id bigint, t struct<a: bigint, b: bigint>, key binary, n bigint, sign binary, buckets array<bigint>")


def _survivors(classes: DataFrame, least: list[int]) -> DataFrame:
    """Members of bucket blocks that have a pair to verify there: bucket, i, j, key, part, band, mask.

    `band` is the bucket's place among the bands, `mask` has a bit for each band in which the member's bucket counts.
    """
    spread = classes.select("key", "n", F.posexplode("buckets").alias("band", "bucket"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    buckets = (spread.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"),
                                            F.bit_xor(F.xxhash64("key")).alias("who"), F.min("key").alias("first"))
               .filter("members > 1"))
    # buckets with the same members are one piece of work, whatever their band
    buckets = stored(buckets.groupBy("members", "who", "first").agg(F.min("bucket").alias("bucket"), F.first("shingles").alias("shingles"))
                     .select("bucket", blocks.alias("blocks")), "near-buckets")
    members = stored(spread.join(buckets, "bucket").select("bucket", "band", "blocks", "key"), "near-members")
    masks = members.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    rows = members.join(masks.join(classes.select("key", "sign"), "key"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), table in sorted_groups(batches, 3):
            pairs = _Members((bucket, i, j), table).pairs(least)
            if len(pairs):
                yield from table.take(np.unique(pairs)).drop_columns(["sign"]).combine_chunks().to_batches()
        release_memory()

    return _by_block_pair(_in_blocks(rows), "key", "part", "band", "mask", "sign").mapInArrow(
        compare, "bucket bigint, i int, j int, key binary, part int, band int, mask bigint")


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, chosen: DataFrame) -> DataFrame:
    """key, found: the shingles of each chosen set, from one of its texts (given by hash and id). A row that repeats both repeats here."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(hash128(text).alias("t"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("id"), text.alias("text"))
    # most texts have no near duplicate: they are not shuffled
    words = stored(bit_filter(chosen.select("t.a")), "near-filter")
    texts = with_filter(texts, words, F.col("t.a"), "_may").filter("_may").drop("_may")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, size=SLICE_BYTES):
                sets = [shingles(words, SHINGLE).tobytes() for words in word_hashes(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "found"])
        release_memory()

    return texts.join(chosen, ["t", "id"]).select("key", "text").mapInArrow(cut, "key binary, found binary")


def _verified(survivors: DataFrame, classes: DataFrame, sets: DataFrame, least: list[int], threshold: float) -> DataFrame:
    """Per set how many documents it is linked with in a block (`links`), and edges (u, v) that connect what is linked."""
    rows = survivors.join(sets, "key").join(classes.select("key", "copies", "sign"), "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in sorted_groups(batches, 3):
            first = {key: row for row, key in enumerate(table.column("key").to_pylist())}  # rows that repeat id and text
            table = table.take(sorted(first.values()))
            members = _Members(group, table)
            pairs = members.pairs(least)
            if not len(pairs):
                continue
            sets = [np.frombuffer(found, np.uint64) for found in table.column("found").to_pylist()]
            left, right = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
            hit = linked(sets, left, right, threshold)
            pairs = pairs[hit[np.searchsorted(left, pairs[:, 0]), np.searchsorted(right, pairs[:, 1])]]
            copies = table.column("copies").to_numpy()
            count = np.zeros(len(copies), np.int64)
            np.add.at(count, pairs[:, 0], copies[pairs[:, 1]])
            np.add.at(count, pairs[:, 1], copies[pairs[:, 0]])
            out = [(members.keys[r], None, int(count[r])) for r in np.flatnonzero(count)]
            out += [(members.keys[a], members.keys[b], 0) for a, b in _forest(len(copies), pairs)]
            if out:
                u, v, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["u", "v", "links"])
        release_memory()

    return _by_block_pair(rows, "key", "part", "band", "mask", "sign", "copies", "found").mapInArrow(verify, "u binary, v binary, links bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: id, `class_id`, `class_size`, `n_links`, `first_in_class`.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles is `threshold` or more;
    a text of fewer words is one shingle. `n_links` counts all linked documents, equal texts included; classes are
    the connected components, named by their smallest id (NULL ids are passed over; a class of NULL ids has NULL),
    and `first_in_class` is true for one row of each class, the one with that id. NULL, empty and wordless texts
    have no shingles, no links, and each is a class of its own. Only the id is passed on.

    Documents with equal shingle sets count once, with their number. MinHash bands propose pairs: one at the
    threshold shares none of them with a chance of 5e-8. Pairs in a bucket are compared hash by hash and dropped when
    their posterior chance falls below `tolerance`; the others are verified exactly on whole texts, each in the first
    bucket that both ends share, so that links are counted once. Classes come from true links only: candidates that are
    no links connect nothing, however long their chains.
    Pairs are never rows: a task takes two blocks of a bucket and returns counts and a spanning forest.
    Large buckets are thus split over pairs of blocks of bounded size; their work is that of their links.
    """
    return _classified(docs, id_col, text_col, threshold, tolerance)[0].drop("_t")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                tolerance: float = TOLERANCE) -> DataFrame:
    """The input without near duplicates: of each class of `near_duplicates` its first row, whole.

    Rows that repeat both id and text count as one, wordless ones included.
    """
    found, sketched = _classified(docs, id_col, text_col, threshold, tolerance)
    found = found.filter("first_in_class")
    stay = stored(found.select(F.coalesce(F.col(f"`{id_col}`"), F.lit(0)).alias("_i"), F.col(f"`{id_col}`").isNull().alias("_none"), "_t"), "near-stay")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = ["_i", "_none", "_t"]
    rows = docs.withColumns({"_i": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)), "_none": F.col(f"`{id_col}`").isNull(), "_t": hash128(text)})
    rows = rows.join(stay.distinct(), key, "left_semi")
    repeated = sketched.groupBy("id", "t").count().filter("count > 1").limit(1).count()
    return (rows.dropDuplicates(key) if repeated else rows).drop(*key)


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """`near_duplicates` with the hash of the text as `_t`, and the stored sketches."""
    rows = stored(sketches(docs, id_col, text_col), "near-sketches")
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("sign").alias("sign"),
        F.first("buckets").alias("buckets"), F.min(F.struct("t", F.coalesce("id", F.lit(0)).alias("id"))).alias("text"))
    classes = stored(classes, "near-classes")
    least = least_matches(threshold, tolerance)
    survivors = stored(_survivors(classes, least), "near-survivors")
    chosen = survivors.select("key").distinct().join(classes, "key").select("key", F.col("text.t").alias("t"), F.col("text.id").alias("id"))
    sets = stored(_shingle_sets(docs, id_col, text_col, stored(chosen, "near-chosen")), "near-sets")
    found = stored(_verified(survivors, classes, sets, least, threshold), "near-links")

    links = found.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("v is not null").select("u", "v")).select(F.col("node").alias("key"), "root")
    info = (classes.select("key", "copies", "least").join(links, "key", "left").join(groups, "key", "left")
            .withColumn("root", F.coalesce("root", "key")))
    info = stored(info, "near-info")
    names = stored(info.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "near-names")
    info = stored(info.join(names, "root").select("key", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root"), "near-classes-named")

    out = rows.select("id", "t", "key", F.monotonically_increasing_id().alias("_row")).join(info, "key", "left")
    alone = F.col("key").isNull()
    first = (out.filter(~alone & F.col("id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("_row").alias("_first")))
    out = stored(out, "near-rows").join(stored(first, "near-first"), "root", "left")
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (alone | F.coalesce(F.col("_row") == F.col("_first"), F.lit(False))).alias("first_in_class"), F.col("t").alias("_t")), rows
