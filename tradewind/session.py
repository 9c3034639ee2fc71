"""Session settings and the shared work folder."""

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# AQE does the run-time work: coalescing small partitions, switching to a broadcast only when the measured
# side is small, and splitting skewed join partitions. The split is forced because a change operator often
# groups by the key it has just joined on; without it a key that most requests name stays in one task.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    # an overflow that no check has caught is an error, not a silent NULL
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # so many to begin with: AQE puts small ones together, but does not split what a fixed number makes too large to
    # sort in memory
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    # a file's bytes are some twelve times as many as rows, shuffled ones some eight times: a task that takes the
    # default of 128 or 64 MB of them spills
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # one state row per payment: kept on disk instead of on the executors' heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Sets the recommended options on a session that was made elsewhere."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("tradewind")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # rounds leave a copy of their state each; what nothing refers to any more is deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # recording the call site of every column expression costs more than building small plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in spark.checkpoint.dir. Only a local session gets a folder of its own.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tradewind-"))
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name for one intermediate table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def held(df: DataFrame, purpose: str = "held") -> DataFrame:
    """The rows of a DataFrame, made once and read from files in the work folder.

    Unlike a checkpoint, which is rows as they lie in memory, files are compressed and give each reader its columns only.
    What files cannot store (a column without a type) is checkpointed.
    """
    folder = work_folder(df.sparkSession, purpose)
    try:
        df.write.parquet(folder)
    except AnalysisException as refused:
        if refused.getCondition() != "UNSUPPORTED_DATA_TYPE_FOR_DATASOURCE":
            raise
        return df.checkpoint()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
