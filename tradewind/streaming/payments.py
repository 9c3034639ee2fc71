"""Payment updates as a stream; the final state equals the batch operator on the same updates."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.changes.status import judge_payments, merge_payments, payment_fold
from ..plans.requests import rejections
from ..sources.requests import parse_requests
from .. import schema


# The running state written by one micro-batch; a later batch's row of a payment replaces an earlier one.
_STATE = ("payment_id string, _status string, _reference string, _last_ts timestamp_ntz, _was_paid boolean, "
          "batch bigint")
# What the batch operator would refuse, and lines that are no request.
_FAULTS = "request_id string, request_ts timestamp_ntz, reason string, line string"


def stream_requests(spark: SparkSession, path: str, kind: str = "payment", files_per_batch: int = 1000) -> DataFrame:
    """JSON-lines request files as they arrive in a folder; `_line` keeps the text of a line that is no request."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    ok, bad = parse_requests(lines, kind)
    return ok.withColumn("_line", F.lit(None).cast("string")).unionByName(bad.select(F.col("line").alias("_line")), allowMissingColumns=True)


def payments_stream(t, updates: DataFrame, folder: str, as_of: Column) -> dict[str, DataFrame]:
    """Folds a stream of payment updates and merges the result into payments and orders.

    Every aggregate is a maximum that ignores order and repetition, so no watermark is needed and nothing is
    dropped as late; the state holds one row per payment. Each micro-batch writes its changed rows to its own
    folder, overwriting it when a failed batch is repeated; `compact_state` merges
    them. Beside the tables the result has `rejected` (unknown statuses and payments, with their reason, once per
    request) and `malformed` (lines that are no request).
    """
    spark = updates.sparkSession
    state, faults, progress = f"{folder}/state", f"{folder}/faults", f"{folder}/progress"
    if "_line" not in updates.columns:
        updates = updates.withColumn("_line", F.lit(None).cast("string"))

    # a stream without any update still has a state and faults to read
    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(f"{state}/part=none")
    spark.createDataFrame([], _FAULTS).write.mode("overwrite").parquet(f"{faults}/part=none")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{state}/part={number}")

    def write_faults(batch: DataFrame, number: int) -> None:
        judged = judge_payments(batch.filter("_line is null"), t["payments"]).filter("reason is not null")
        rows = rejections(judged).withColumn("line", F.lit(None).cast("string")).unionByName(
            batch.filter("_line is not null").select(F.col("_line").alias("line")), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{faults}/part={number}")

    sound = updates.filter(F.col("status").isin(schema.PAYMENT_STATUS) & F.col("payment_id").isNotNull() & F.col("_line").isNull())
    unsure = (
        updates.writeStream.foreachBatch(write_faults)
        .option("checkpointLocation", f"{progress}-faults").trigger(availableNow=True).start()
    )
    query = (
        sound.groupBy("payment_id").agg(*payment_fold())
        .writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    unsure.awaitTermination()
    found = spark.read.schema(_FAULTS).option("recursiveFileLookup", "true").parquet(faults)
    return {
        **merge_payments(t, stream_state(spark, state), as_of)[0],
        "rejected": found.filter("line is null").drop("line").distinct(),
        "malformed": found.filter("line is not null").select("line"),
    }


def compact_state(spark: SparkSession, state: str, merged: str) -> DataFrame:
    """Writes the latest row per payment over all micro-batches to the folder `merged`, from which a new stream's
    state can start: its rows have the number of the batch they come from, so that later batches replace them."""
    written = spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(state)
    row = F.struct(*[c for c in written.columns if c != "payment_id"])
    latest = written.groupBy("payment_id").agg(F.max_by(row, "batch").alias("row")).select("payment_id", "row.*")
    latest.write.mode("overwrite").parquet(merged)
    return spark.read.schema(_STATE).parquet(merged)


def stream_state(spark: SparkSession, state: str) -> DataFrame:
    """Latest folded row per payment over all micro-batches."""
    written = spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(state)
    row = F.struct("_status", "_reference", "_last_ts", "_was_paid")
    return (
        written.groupBy("payment_id").agg(F.max_by(row, "batch").alias("row")).select("payment_id", "row.*")
    )
