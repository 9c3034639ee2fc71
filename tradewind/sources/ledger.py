"""The request ids of all batches so far, so that a request repeated in a later batch changes nothing."""

import hashlib
import inspect
from collections.abc import Callable
from functools import reduce
from math import ceil
from typing import NamedTuple
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.requests import Change, rejections
from ..session import checkpoint_dir, held, work_folder
from .snapshot import merge_snapshot

BITS_PER_ID = 16
ROWS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 4096
FANOUT = 8  # segments of a level that are merged into one of the next


class Segment(NamedTuple):
    """Ids that were added together: their number of filter words, of hash buckets, and their level."""

    name: str
    level: int
    words: int
    buckets: int
    n: int


def _hash(kind: Column) -> Column:
    return F.xxhash64(kind, F.col("request_id"))


def _mask(kind: Column) -> Column:
    """Four bits of a filter word."""
    bits = F.xxhash64(F.lit("filter"), kind, F.col("request_id"))
    places = [F.pmod(F.shiftright(bits, shift), F.lit(64)).cast("int") for shift in (0, 6, 12, 18)]
    ones = [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places]
    return reduce(lambda a, b: a.bitwiseOR(b), ones)


class RequestLedger:
    """Ids by kind of request, as segments below a folder.

    A segment is a table of ids in folders by a hash of the id, and a Bloom filter over them: words of 64 bits, one word
    and four bits of it per id, 16 bits of filter for each id. A batch joins its ids with the filter words they fall
    on; nearly all ids are new and end there. Only buckets that some id may be in are read, and there the ids
    themselves decide. Each batch adds a segment; eight of a level are merged into one of the next, so there are
    few, however many batches. A segment counts from the moment its `info` is written, the last step; merged ones
    are no longer read and may be deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.staging = spark, f"{path.rstrip('/')}/segments", f"{path.rstrip('/')}/staging"
        checkpoint_dir(spark)

    def segments(self) -> list[Segment]:
        try:
            rows = self.spark.read.schema("name string, level int, words long, buckets long, n long, replaces array<string>").json(
                f"{self.path}/*/info").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        replaced = {name for r in rows for name in r.replaces or []}
        return [Segment(r.name, r.level, r.words, r.buckets, r.n) for r in sorted(rows, key=lambda r: r.name) if r.name not in replaced]

    def known(self, kind: str, requests: DataFrame) -> DataFrame | None:
        """The distinct request ids of the batch that earlier batches of this kind had; None if there are none."""
        live = self.segments()
        if not live:
            return None
        ids = requests.select("request_id").filter("request_id is not null").distinct().select(
            "request_id", _hash(F.lit(kind)).alias("h"), _mask(F.lit(kind)).alias("mask"))
        each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("segment"), F.lit(s.words).alias("words"), F.lit(s.buckets).alias("buckets")) for s in live]))
        probes = ids.withColumn("s", each).select(
            "request_id", "mask", "s.segment", F.pmod("h", "s.words").alias("word"), F.pmod("h", "s.buckets").alias("bucket"))
        filters = reduce(DataFrame.unionByName, [self._read(s.name, "filter", "word long, bits long").withColumn("segment", F.lit(s.name)) for s in live])
        maybe = probes.join(filters, ["segment", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        maybe = held(maybe.select("segment", "bucket", "request_id"), "ledger-maybe")
        places: dict[str, list[int]] = {}
        for r in maybe.select("segment", "bucket").distinct().collect():
            places.setdefault(r.segment, []).append(r.bucket)
        if not places:
            return None
        found = reduce(DataFrame.unionByName, [
            self._read(name, "ids", "kind string, request_id string, bucket long").filter(F.col("bucket").isin(buckets) & (F.col("kind") == kind))
            .select("request_id").join(maybe.filter(F.col("segment") == name).select("request_id"), "request_id", "left_semi")
            for name, buckets in places.items()]).distinct()
        found = held(found, "ledger-found")
        return None if found.isEmpty() else found

    def split(self, kind: str, requests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(requests whose id is new, rejections of the others). Requests without an id are always new."""
        known = self.known(kind, requests)
        if known is None:
            return requests, None
        repeated = requests.join(known, "request_id", "left_semi").withColumn("reason", F.lit("duplicate_request"))
        return requests.join(known, "request_id", "left_anti").select(*requests.columns), rejections(repeated)

    def add(self, kind: str, requests: DataFrame, batch: str) -> None:
        """Records the ids of a batch, accepted and rejected alike. Adding a batch again under its name changes nothing."""
        ids = requests.select(F.lit(kind).alias("kind"), "request_id").filter("request_id is not null").distinct()
        self._put(_name(kind, batch), 0, ids, [])
        self._compact()

    def _read(self, name: str, part: str, declared: str) -> DataFrame:
        return self.spark.read.schema(declared).parquet(f"{self.path}/{name}/{part}")

    def _put(self, name: str, level: int, ids: DataFrame, replaces: list[str]) -> None:
        folder = work_folder(self.spark, "ledger-ids")
        ids.write.parquet(folder)
        ids = self.spark.read.schema("kind string, request_id string").parquet(folder)
        n = ids.count()
        words = 1 << max(0, ceil(max(n, 1) * BITS_PER_ID / 64) - 1).bit_length()
        buckets = max(1, min(MOST_BUCKETS, ceil(n / ROWS_PER_BUCKET)))
        h = _hash(F.col("kind"))
        (ids.withColumn("bucket", F.pmod(h, F.lit(buckets))).repartitionByRange("bucket", "request_id").sortWithinPartitions("bucket", "request_id")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/ids"))
        (ids.groupBy(F.pmod(h, F.lit(words)).alias("word")).agg(F.bit_or(_mask(F.col("kind"))).alias("bits"))
         .write.mode("overwrite").parquet(f"{self.path}/{name}/filter"))
        info = self.spark.createDataFrame([(name, level, words, buckets, n, replaces)],
                                          "name string, level int, words long, buckets long, n long, replaces array<string>")
        info.coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}/info")

    def _compact(self) -> None:
        live = self.segments()
        for level in range(max((s.level for s in live), default=0) + 1):
            mine = [s for s in self.segments() if s.level == level]
            if len(mine) >= FANOUT:
                ids = reduce(DataFrame.unionByName, [self._read(s.name, "ids", "kind string, request_id string, bucket long").drop("bucket") for s in mine])
                self._put(f"level-{level + 1}-{uuid4().hex}", level + 1, ids, [s.name for s in mine])


def apply_once(ledger: RequestLedger, kind: str, operator: Callable[..., Change], *args, **named) -> Change:
    """A change operator on the requests whose ids no earlier batch had; the others are rejected as `duplicate_request`.

    The arguments are those of the operator. The ids are recorded by `commit`, or by `ledger.add` once the change is written.
    """
    bound = inspect.signature(operator).bind(*args, **named)
    bound.arguments["requests"], repeated = ledger.split(kind, bound.arguments["requests"])
    change = operator(*bound.args, **bound.kwargs)
    return change if repeated is None else change._replace(rejected=change.rejected.unionByName(repeated))


def commit(spark: SparkSession, path: str, ledger: RequestLedger, kind: str, batch: str, requests: DataFrame, change: Change) -> dict[str, list[str]]:
    """Merges a change into the snapshot at `path`, then records the batch's ids; returns the rewritten folders.

    The change is stored beside the ledger under the name of the batch before anything is merged. A commit that was lost
    half-way is run again under that name: it goes on with what is stored, not with a change made from half-merged
    tables. A batch that is to be committed must therefore have a name of its own.
    """
    folders = merge_snapshot(spark, change.sets, path, staging=f"{ledger.staging}/{_name(kind, batch)}")
    ledger.add(kind, requests, batch)
    return folders


def _name(kind: str, batch: str) -> str:
    return "batch-" + hashlib.sha256(f"{kind}:{batch}".encode()).hexdigest()[:32]
