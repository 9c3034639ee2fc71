"""Lines that many documents share, found with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import hash128, stored, without

# Fixed value: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


class LineRuns:
    """Counts of line hashes as sorted runs on levels, like a log-structured merge tree.

    `add` anti-joins a batch with the runs' settled hashes (those that `threshold` documents already have, so
    that more counts change nothing) and writes the rest as a run of level 0, sorted by hash. Once a level has
    `fanout` runs they are merged into one run of the next level; a hash is thus rewritten a logarithmic
    number of times. Runs are tables in the shared folder.
    """

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 4):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> DataFrame | None:
        found = [run for level in self.levels for run in level]
        out = found[0] if found else None
        for run in found[1:]:
            out = out.unionByName(run)
        return out

    def add(self, keys: DataFrame) -> None:
        """`keys`: columns a, b; one row per document and hash."""
        counted = keys.groupBy("a", "b").agg(F.count("*").alias("n"))
        known = self.runs()
        if known is not None:
            counted = counted.join(known.filter(F.col("n") >= self.threshold).select("a", "b"), ["a", "b"], "left_anti")
        self._put(0, counted)

    def _put(self, level: int, rows: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(stored(rows.select("a", "b", "n").sortWithinPartitions("a", "b"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)
            self.levels[level] = []
            self._put(level + 1, merged.groupBy("a", "b").agg(F.sum("n").alias("n")))

    def frequent(self) -> DataFrame:
        """Hashes (a, b) that at least `threshold` documents have."""
        found = self.runs()
        return found.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.threshold).select("a", "b")


def drop_common_lines(
    df: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 6, fanout: int = 4,
    once_per_text: bool = False,
) -> DataFrame:
    """The input with `n_lines`, `n_dropped` and `kept_text`; `text_col` itself stays as it was.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least `min_chars` code
    points that at least `min_docs` rows have lose their lines everywhere; the others stay, joined by line
    feeds. NULL and '' are one empty line and give ''. A row counts once per key, a repeated row counts again.
    With `once_per_text`, rows of the same text count once together, so that a text's own copies do not make its
    lines common; its lines are then lost from all copies or from none.
    Input columns named like a result column are replaced. Empty tables give an empty result.

    Hashes have 128 bits. The input's partitions are dealt into `batches`, which are added to the runs one
    after the other. Texts are joined only with the hashes that their own lines lose, under a hash of the
    text: copies share one entry, and a text that a third of the rows have is split by the adaptive join.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n")
    long_enough = lambda k: F.char_length(k) >= min_chars
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines, line_key), long_enough), hash128))
    batch = F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch")
    keyed = df.select(hash128(text).alias("t"), keys.alias("keys"))
    if once_per_text:
        keyed = keyed.dropDuplicates(["t"])
    found = stored(keyed.select(batch, "t", F.explode("keys").alias("k")).select("batch", "t", "k.a", "k.b"), "line-keys", "batch")

    runs = LineRuns(df.sparkSession, min_docs, fanout)
    for i in range(batches):
        runs.add(found.filter(F.col("batch") == i).select("a", "b"))
    frequent = stored(runs.frequent(), "line-frequent")
    lost = stored(
        found.join(frequent, ["a", "b"]).groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("lost")), "line-lost")

    added = ["n_lines", "n_dropped", "kept_text"]
    kept = without(df, added)
    rows = kept.withColumn("_t", hash128(text)).join(lost.withColumnRenamed("t", "_t"), "_t", "left")
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda x: ~(long_enough(line_key(x)) & F.array_contains(F.col("lost"), hash128(line_key(x)))))
    rows = rows.withColumn("_stays", F.when(F.col("lost").isNotNull(), stays))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept.columns], F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_stays")).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), text).otherwise(F.array_join("_stays", "\n")).alias("kept_text"))
