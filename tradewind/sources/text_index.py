"""Trigrams of names, so that a 'contains' filter reads the names that may match instead of all."""

import hashlib
from collections.abc import Iterable
from functools import reduce
from math import ceil
from typing import NamedTuple
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions import contains
from ..plans.requests import ChangeSet
from ..session import checkpoint_dir, held, work_folder
from .ledger import FANOUT
from .snapshot import read_keys

# The columns that lists are searched by.
SEARCHED = {"products": ("product_name",), "pets": ("pet_name", "species", "breed"), "users": ("name", "email")}

GRAM = 3
NEAR = 100_000  # so many keys may be broadcast
POSTINGS_PER_FILE = 500_000  # a task sorts so many, whatever their number
SCAN_SHARE = 8  # a gram of more than one in so many rows is no help: the scan needs no shuffle

_POSTINGS = "gram string, key string, text string, field string"


class Segment(NamedTuple):
    """Texts that were added together: the number of rows by field, and the segment's level."""

    name: str
    level: int
    rows: dict[str, int]


def needle_grams(spark: SparkSession, needle: str) -> list[str] | None:
    """Trigrams that every text matching `ilike '%needle%'` holds; none if the pattern ends in the middle of an escape.

    They come from the stretches between wildcards, in the lower case that `ilike` itself compares in.
    """
    pattern = spark.sql("SELECT lower(:pattern) AS p", {"pattern": f"%{needle}%"}).first().p
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            if at == len(pattern) or pattern[at] not in "%_\\":
                return None
            runs[-1] += pattern[at]
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
        at += 1
    return sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def postings(rows: DataFrame, table: str, column: str) -> DataFrame:
    """One row per text and distinct trigram of its lower case. Texts shorter than three characters and NULL have none."""
    lowered = F.lower(column)
    starts = F.sequence(F.lit(1), F.length(lowered) - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr(lowered, i, F.lit(GRAM))))
    return rows.filter(F.length(lowered) >= GRAM).select(
        F.explode(grams).alias("gram"), F.col(schema.PRIMARY_KEY[table]).cast("string").alias("key"),
        F.col(column).cast("string").alias("text"), F.lit(f"{table}.{column}").alias("field"))


class TextIndex:
    """Posting lists of trigrams below a folder, as segments.

    A posting carries its text, so a search reads one list, that of the pattern's rarest trigram, and matches there;
    this costs about as many copies of a text as it has characters. Lists lie in folders by column, ranged and sorted by
    (trigram, key): a trigram of most texts spreads over many files, and a search skips the row groups of others.
    Counts by trigram say which is the rarest.

    A list may hold what is no longer so: a batch adds postings of the texts it wrote and removes none. Searches
    therefore narrow the table down, and the filter itself, on the rows of the table, decides. Missing entries are the
    one thing that may not be: every new or changed row must be added. Segments are merged eight of a level at a
    time, and count from the moment their `info` is written; `replace` starts afresh from whole tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/segments"
        checkpoint_dir(spark)

    def segments(self) -> list[Segment]:
        try:
            rows = self.spark.read.schema("name string, level int, rows map<string,long>, replaces array<string>").json(f"{self.path}/*/info").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        replaced = {name for r in rows for name in r.replaces or []}
        return [Segment(r.name, r.level, r.rows or {}) for r in sorted(rows, key=lambda r: r.name) if r.name not in replaced]

    def add(self, tables: dict[str, DataFrame], batch: str) -> None:
        """Adds the searched columns of all rows given. Adding a batch again under its name changes nothing."""
        name = "batch-" + hashlib.sha256(batch.encode()).hexdigest()[:32]
        self._put(name, 0, *self._texts(tables), [])
        self._compact()

    def add_changes(self, sets: dict[str, ChangeSet], batch: str) -> None:
        """Adds the texts that a change wrote. Rows it removed stay in the lists, and are not found in the table."""
        written = {}
        for table, changed in sets.items():
            if table in SEARCHED and changed.rows is not None:
                columns = [c for c in (schema.PRIMARY_KEY[table], *SEARCHED[table]) if c in changed.rows.columns]
                written[table] = held(changed.rows.select(*columns), "changed")  # counted and listed
        self.add(written, batch)

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Makes whole tables the only content."""
        self._put(f"whole-{uuid4().hex}", 0, *self._texts(tables), [s.name for s in self.segments()])

    def keys(self, table: str, column: str, needle: str) -> tuple[DataFrame, int] | None:
        """The keys of texts that contain the needle by `ilike`, among them all that still do, and a bound on their number.

        None where the lists are no help: the pattern has no three characters in a row, or its rarest trigram is in
        more than one in eight rows, or nothing has been added for this column.
        """
        key, field = schema.PRIMARY_KEY[table], f"{table}.{column}"
        live = [s for s in self.segments() if field in s.rows]
        grams = needle_grams(self.spark, needle)
        if not grams or not live:
            return None
        counts = reduce(DataFrame.unionByName, [self._read(s.name, "counts", "gram string, n long, field string") for s in live])
        found = counts.filter((F.col("field") == field) & F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        number = {gram: 0 for gram in grams} | {r.gram: r.n for r in found}
        rarest = min(grams, key=lambda gram: (number[gram], gram))
        if number[rarest] > max(NEAR, sum(s.rows[field] for s in live) // SCAN_SHARE):
            return None
        lists = reduce(DataFrame.unionByName, [self._read(s.name, "postings", _POSTINGS) for s in live])
        hits = lists.filter((F.col("field") == field) & (F.col("gram") == rarest) & contains("text", needle))
        return hits.select(F.col("key").alias(key)), number[rarest]

    def narrowed(self, tables: dict[str, DataFrame], table: str, needles: dict[str, str | None], any_of: bool = False,
                 snapshot: str | None = None) -> dict[str, DataFrame]:
        """The tables, with `table` cut to rows that may match all needles (or, with `any_of`, one of them), by column.

        The operator that gets them applies its own filters as ever: `list_products(index.narrowed(t, "products",
        {"product_name": "bowl"}), ItemFilters(search="bowl"))`. Needles that are empty or that no list helps with leave
        the table as it is. With `snapshot`, the folder that the tables were loaded from, only the key folders of the
        rows found are read.
        """
        wanted = {column: needle for column, needle in needles.items() if needle}
        found = [self.keys(table, column, needle) for column, needle in wanted.items()]
        if any_of:
            if not found or None in found:
                return tables
            found = [(reduce(DataFrame.unionByName, [keys for keys, _ in found]), sum(n for _, n in found))]
        helpful = sorted((f for f in found if f is not None), key=lambda f: f[1])
        rows = tables[table]
        for i, (keys, bound) in enumerate(helpful):
            near = bound <= NEAR
            if i == 0 and near and snapshot is not None:
                rows = read_keys(self.spark, snapshot, table, keys, rows.columns)
            rows = rows.join(F.broadcast(keys) if near else keys, schema.PRIMARY_KEY[table], "left_semi")
        return {**tables, table: rows.select(*tables[table].columns)}

    def _read(self, name: str, part: str, declared: str) -> DataFrame:
        return self.spark.read.schema(declared).parquet(f"{self.path}/{name}/{part}")

    def _texts(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, int]]:
        fields = [(table, column) for table in SEARCHED if table in tables for column in SEARCHED[table] if column in tables[table].columns]
        made = [postings(tables[table], table, column) for table, column in fields]
        number = {table: tables[table].count() for table, _ in dict(fields).items()}
        empty = self.spark.createDataFrame([], _POSTINGS)
        return reduce(DataFrame.unionByName, made, empty), {f"{table}.{column}": number[table] for table, column in fields}

    def _put(self, name: str, level: int, lists: DataFrame, rows: dict[str, int], replaces: Iterable[str]) -> None:
        lists = held(lists, "text-index")
        order = ["field", "gram", "key"]
        parts = max(1, ceil(lists.count() / POSTINGS_PER_FILE))
        (lists.repartitionByRange(parts, *order).sortWithinPartitions(*order)
         .write.mode("overwrite").partitionBy("field").parquet(f"{self.path}/{name}/postings"))
        (lists.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("field", "gram").sortWithinPartitions("field", "gram")
         .write.mode("overwrite").partitionBy("field").parquet(f"{self.path}/{name}/counts"))
        info = self.spark.createDataFrame([(name, level, rows, list(replaces))], "name string, level int, rows map<string,long>, replaces array<string>")
        info.coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}/info")

    def _compact(self) -> None:
        for level in range(max((s.level for s in self.segments()), default=0) + 1):
            mine = [s for s in self.segments() if s.level == level]
            if len(mine) >= FANOUT:
                lists = reduce(DataFrame.unionByName, [self._read(s.name, "postings", _POSTINGS) for s in mine]).distinct()
                fields = {field for s in mine for field in s.rows}
                rows = {field: sum(s.rows.get(field, 0) for s in mine) for field in fields}
                self._put(f"level-{level + 1}-{uuid4().hex}", level + 1, lists, rows, [s.name for s in mine])
