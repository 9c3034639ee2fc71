"""What each of five filters removes in every order: difference arrays over the Lehmer ranks of the orders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import slices, stored

# The filters by letter, their limits, and the characters of D.
FILTERS = "ABCDE"  # few words, few distinct words, many capitals, marks, a copy of an earlier document
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
_MARKS, _CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG_TEXT = 4 << 20  # bytes from which words are taken one by one, not as a list


def text_mask(raw: bytes, code_points: int) -> int:
    """Bits 0 to 3: whether a text fails A, B, C and D."""
    if len(raw) > LONG_TEXT:
        words, distinct = 0, set()
        for match in _WORD.finditer(raw):
            words += 1
            distinct.add(match[0])
    else:
        found = raw.split()  # of bytes: at exactly the blanks that _WORD leaves out
        words, distinct = len(found), set(found)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((words < MIN_WORDS) | (100 * len(distinct) < DISTINCT_PERCENT * words) << 1
            | (100 * capitals > CAPITAL_PERCENT * code_points) << 2
            | (len(raw.translate(None, _MARKS)) < len(raw)) << 3)


def lehmer_rank(prefix: tuple[int, ...], k: int) -> int:
    """Rank of the first permutation of 0..k-1 in lexicographic order that begins with `prefix`."""
    rank, left = 0, list(range(k))
    for i, filter_ in enumerate(prefix):
        at = left.index(filter_)  # the digit of the Lehmer code: smaller numbers not yet used
        rank += at * factorial(k - 1 - i)
        left.pop(at)
    return rank


def removal_intervals(mask: int, k: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders in which a document with this mask goes at that step.

    It goes at step s in the orders that begin with s - 1 filters it passes and one it fails: for each such
    beginning one interval of lexicographic ranks. Neighbouring intervals of a step are joined.
    """
    failed = [f for f in range(k) if mask >> f & 1]
    passed = [f for f in range(k) if not mask >> f & 1]
    out: list[tuple[int, int, int]] = []
    for step in range(1, len(passed) + 2 if failed else 0):
        width = factorial(k - step)
        starts = sorted(lehmer_rank((*before, f), k) for before in permutations(passed, step - 1) for f in failed)
        first = end = None
        for start in starts:
            if start != end:
                if end is not None:
                    out.append((step, first, end))
                first = start
            end = start + width
        if end is not None:
            out.append((step, first, end))
    return out


def order_table(masks: dict[int, tuple[int, ...]], letters: str = FILTERS) -> dict[str, np.ndarray | list]:
    """The audit of one part from its documents per mask, given as {mask: (documents, good ones, toxic ones)}.

    Each mask adds its counts at the start of its intervals and takes them off at the end; prefix sums over the
    ranks of all orders then give what every step of every order removes. Columns have k! x k values, by rank, then step.
    """
    k = len(letters)
    ranks = factorial(k)
    change = np.zeros((3, k, ranks + 1), np.int64)
    for mask, counts in masks.items():
        for step, start, end in removal_intervals(mask, k):
            change[:, step - 1, start] += counts
            change[:, step - 1, end] -= counts
    lost = change.cumsum(axis=2)[:, :, :ranks].transpose(0, 2, 1)  # by count, rank, step
    total = sum(counts[0] for counts in masks.values())
    failing = np.array([sum(c[0] for m, c in masks.items() if m >> f & 1) for f in range(k)], np.int64)
    alone = np.array([masks.get(1 << f, (0,))[0] for f in range(k)], np.int64)
    orders = np.array(list(permutations(range(k))))  # in lexicographic order, so that rows are ranks
    removed = lost[0]
    shapley = np.bincount(orders.ravel(), removed.ravel(), k).astype(np.int64)
    if removed.sum() > 1 << 53:  # beyond what the doubles of bincount hold
        shapley = np.array([int(removed[orders == f].sum()) for f in range(k)], np.int64)
    earlier = np.cumsum(removed, axis=1)
    return {
        "filter_order": [name for o in orders for name in ["".join(letters[f] for f in o)] * k],
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), ranks),
        "kept": (total - earlier).ravel(), "removed": removed.ravel(),
        "redundant": (failing[orders] - removed).ravel(), "unique_fails": alone[orders].ravel(),
        "good_lost": lost[1].ravel(), "toxic_lost": lost[2].ravel(), "shapley": shapley[orders].ravel()}


def fail_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: `id`, `part`, `mask` (A to D) and the 128-bit hash of its text as `a`, `b`."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kept = rows.drop("text").schema.fields
    schema = T.StructType([*kept, T.StructField("mask", T.IntegerType()), T.StructField("a", T.LongType()),
                           T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                points = pc.utf8_length(batch.column(2)).to_pylist()
                raws = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary())
                masks, digests = [], []
                for raw, code_points in zip(raws.to_pylist(), points):
                    masks.append(text_mask(raw, code_points))
                    digests.append(blake2b(raw, digest_size=16).digest())
                words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(words[:, 0]), pa.array(words[:, 1])],
                    schema.names)

    return rows.mapInArrow(run, schema)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                  quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 100 words; B distinct words under 80 % of all; C capitals A-Z over 10 % of the code points;
    D holds one of # $ % & * |; E the same text as a document with a smaller id, in any part. Words stand between
    blanks (space, \\t to \\r) and keep their case. All 120 orders are listed, each with five steps. `redundant`
    fails the step's filter but went earlier; `unique_fails` fails no other filter; `shapley` adds up what the
    step's filter removes over all orders.

    NULL texts count as empty, a NULL part as ''. Every row is a document: rows that repeat an id and its text
    fail E together or not at all, and a NULL id is neither smaller nor larger than another. A document is good
    or toxic if any of its labels says so; others count as neither. Empty tables give an empty result. Only
    the named columns are read, so further columns cannot clash.

    Texts are read once and do not move. Copies meet by the hash of their text in sums that combine in the map
    tasks, so a text that a third of the rows have is a few rows per task. What is left per part is at most 32
    counts, which become its 600 rows in one task.
    """
    marked = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(F.col(f"`{quality_col}`") == 1).alias("good"), F.max(F.col(f"`{toxic_col}`") == 1).alias("toxic"))
    rows = fail_masks(docs, id_col, text_col, part_col).join(marked, "id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    group = ["a", "b", "part", "mask", "good", "toxic"]
    by_id = rows.select("id", "a", "b", "part", "mask", *flags).groupBy("id", *group).agg(F.count("*").alias("n"))
    texts = stored(by_id.groupBy(*group).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min("id").alias("first"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_first")), "audit-texts")
    shared = texts.groupBy("a", "b").agg(F.min("first").alias("lead"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    lead = F.when(F.col("first") == F.col("lead"), F.col("at_first")).otherwise(0)
    copies = F.when(F.col("lead").isNull(), F.lit(0)).otherwise(F.col("n") - F.col("no_id") - lead)
    copy_bit = 1 << FILTERS.index("E")
    split = texts.join(shared, ["a", "b"], "left").withColumn("copies", copies.cast("long")).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), F.col("copies").alias("n")))).alias("c"))
    counted = split.filter("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c) for c in ("good", "toxic")])

    def audit(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): (int(n), int(g), int(t)) for m, n, g, t in found[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        return pd.DataFrame({"part": key[0], **order_table(masks)})

    return counted.groupBy("part").applyInPandas(
        audit, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
               "good_lost long, toxic_lost long, shapley long")
