"""Writing a state of the tables, whole or only where a batch touched it."""

import json
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..plans.requests import ChangeSet
from ..session import checkpoint_dir, held, work_folder

# Rows are clustered by the column most lookups use, so that row groups can be skipped on it.
CLUSTER_BY = {
    "users": "user_id", "pets": "seller_id", "products": "seller_id", "cart": "buyer_id", "cart_items": "cart_id",
    "orders": "buyer_id", "order_items": "order_id", "payments": "order_id", "reviews": "product_id",
}

# Tables whose rows belong to an order, and lie in the folder of its month.
MONTHLY = ("order_items", "payments")

# Other tables lie in folders of about so many rows, by a hash of the key: what a batch that touches one row rewrites.
ROWS_PER_PART, MOST_PARTS = 1_000_000, 4096


def folder_column(table: str) -> str | None:
    """The column that the folders of a table are named after; tables without one are a handful of rows."""
    return "month" if table == "orders" or table in MONTHLY else "part" if table in CLUSTER_BY else None


def _part(table: str, parts: int) -> Column:
    """Folder of a row among `parts`; the name says how many there are."""
    number = F.pmod(F.xxhash64(schema.PRIMARY_KEY[table]), F.lit(parts))
    return F.format_string(f"%04d-of-{parts:04d}", number)


def _months(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", F.date_format("created_at", "yyyy-MM").alias("month"))


def _write(df: DataFrame, table: str, location: str, format: str, dynamic: bool = False) -> None:
    """Rows are ranged on the cluster column together with the key, so a value with most of the rows spreads over several files."""
    folder, cluster, key = folder_column(table), CLUSTER_BY.get(table), schema.PRIMARY_KEY[table]
    if folder is None:
        df.write.mode("overwrite").format(format).save(location)
        return
    arranged = df.repartitionByRange(folder, cluster, key).sortWithinPartitions(folder, cluster, key)
    writer = arranged.write.mode("overwrite").partitionBy(folder).format(format)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(location)


def write_snapshot(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """One folder per table; orders, their lines and payments are partitioned by the order's month, others by key.

    Monthly reports read the folders of their months. A line or payment without an order has the month of none.
    The other large tables lie in folders by a hash of their key, one per million rows. They are counted and ranged as
    well as written, so their rows are made once and held in files of the work folder.
    Write to a new folder and switch readers to it when this returns.
    """
    for table, df in tables.items():
        location, folder = f"{path.rstrip('/')}/{table}", folder_column(table)
        if folder is not None:
            df = df.drop(folder)
        if table == "orders":
            df = df.withColumn("month", F.date_format("created_at", "yyyy-MM"))
        elif folder == "month":
            df = df.join(_months(tables["orders"]), "order_id", "left") if "orders" in tables else df.withColumn("month", F.lit(None).cast("string"))
        elif folder == "part":
            df = held(df, f"snapshot-{table}")
            parts = max(1, min(MOST_PARTS, ceil(df.count() / ROWS_PER_PART)))
            df = df.withColumn("part", _part(table, parts))
        _write(df, table, location, format)


def merge_snapshot(spark: SparkSession, sets: dict[str, ChangeSet], path: str, format: str = "parquet",
                   staging: str | None = None) -> dict[str, list[str]]:
    """Writes what a batch changed into a snapshot and returns the folders it rewrote, by table.

    Only folders that hold a changed, new or removed row are read and written: a batch about the orders of one month leaves
    the files of all other months as they are. The change sets are written to `staging` first (a folder of their own in
    the work folder if none is named), since they are made from the tables that are about to change. Tables loaded
    before must be loaded again. A merge that was lost half-way is run again with the same `staging`: if that is
    complete, it is what is merged, and each of its rows replaces the one with its key. An order keeps its
    month: no operator changes created_at.
    """
    checkpoint_dir(spark)
    held = _staged(spark, sets, staging or work_folder(spark, "changed"))
    return {table: _merge(spark, table, changed, held, path.rstrip("/"), format) for table, changed in held.items()}


def _staged(spark: SparkSession, sets: dict[str, ChangeSet], folder: str) -> dict[str, ChangeSet]:
    """The change sets as they are stored in the folder; stored there now unless that was done before."""
    declared = "place string, columns string"
    try:
        stored = spark.read.schema(declared).json(f"{folder}/complete").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = []
        for table, changed in sets.items():
            for part, df in zip(ChangeSet._fields, changed):
                if df is not None:
                    df.write.mode("overwrite").parquet(f"{folder}/{table}/{part}")
                    stored.append((f"{table}/{part}", df.schema.json()))
        spark.createDataFrame(stored, declared).coalesce(1).write.mode("overwrite").json(f"{folder}/complete")
    held = {table: ChangeSet() for table in sets}
    for place, columns in stored:
        table, part = place.split("/")
        df = spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(f"{folder}/{place}")
        held[table] = held.get(table, ChangeSet())._replace(**{part: df})
    return held


def _read(spark: SparkSession, table: str, location: str, format: str) -> DataFrame:
    folder = folder_column(table)
    return spark.read.schema(schema.ddl(table) + (f", {folder} string" if folder else "")).format(format).load(location)


def read_keys(spark: SparkSession, path: str, table: str, keys: DataFrame, columns: list[str], format: str = "parquet") -> DataFrame:
    """The folders of a snapshot's table that rows with these keys would lie in, at most MOST_PARTS; for tables in folders by key."""
    old = _read(spark, table, f"{path.rstrip('/')}/{table}", format)
    key, parts = schema.PRIMARY_KEY[table], _parts(old)
    named = keys.select(F.col(key).cast(old.schema[key].dataType).alias(key)).select(_part(table, parts).alias("part"))
    folders = [r.part for r in named.distinct().collect()]
    return old.filter(F.col("part").isin(folders) if folders else F.lit(False)).select(*columns)


def _merge(spark: SparkSession, table: str, changed: ChangeSet, sets: dict[str, ChangeSet], root: str, format: str) -> list[str]:
    location, folder, key = f"{root}/{table}", folder_column(table), schema.PRIMARY_KEY[table]
    old = _read(spark, table, location, format)
    columns = [c for c in old.columns if c != folder]
    empty = old.limit(0)
    rows = changed.rows.select(*[F.col(c) if c in changed.rows.columns else F.lit(None).alias(c) for c in columns]) if changed.rows is not None else empty.select(*columns)
    rows = rows.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in columns])
    gone = changed.gone.select(key).distinct() if changed.gone is not None else empty.select(key)
    if folder is None:
        kept = old.join(rows.select(key), key, "left_anti").join(gone, key, "left_anti")
        merged = work_folder(spark, f"merged-{table}")
        kept.unionByName(rows).write.parquet(merged)
        _write(spark.read.schema(old.schema).parquet(merged), table, location, format)
        return [location]
    if folder == "part":
        parts = _parts(old)
        rows, gone = rows.withColumn("part", _part(table, parts)), gone.withColumn("part", _part(table, parts))
    elif table == "orders":
        rows = rows.withColumn("month", F.date_format("created_at", "yyyy-MM"))
        gone = old.select(key, "month").join(gone, key, "left_semi")
    else:
        rows = rows.join(_order_months(spark, rows, sets, root, format), "order_id", "left")
        gone = old.select(key, "month").join(gone, key, "left_semi")
    rows, gone = rows.select(*columns, folder), gone.select(key, folder)
    new_folders = {r[0] for r in rows.select(folder).distinct().collect()}
    touched = new_folders | {r[0] for r in gone.select(folder).distinct().collect()}
    if not touched:
        return []
    names = [t for t in touched if t is not None]
    inside = F.col(folder).isin(names) if names else F.lit(False)
    old = old.filter(inside | F.col(folder).isNull() if None in touched else inside)
    kept = old.join(rows.select(key).unionByName(gone.select(key)), key, "left_anti")
    emptied = set()
    if changed.gone is not None:  # a folder that loses its last row is not part of what is written
        emptied = touched - new_folders - {r[0] for r in kept.select(folder).distinct().collect()}
    _write(kept.select(*columns, folder).unionByName(rows), table, location, format, dynamic=True)
    for name in emptied:
        _delete(spark, f"{location}/{folder}={name if name is not None else '__HIVE_DEFAULT_PARTITION__'}")
    return sorted(f"{location}/{folder}={name}" for name in touched)


def _parts(old: DataFrame) -> int:
    """How many folders a table has been dealt into: said by the name of any of them."""
    first = old.select("part").limit(1).collect()
    return int(first[0][0].split("-of-")[1]) if first else 1


def _order_months(spark: SparkSession, rows: DataFrame, sets: dict[str, ChangeSet], root: str, format: str) -> DataFrame:
    """order_id and month of the orders that the rows name: from the snapshot, whose orders are merged by now or later, or from the batch."""
    named = rows.select("order_id").distinct()
    months = _read(spark, "orders", f"{root}/orders", format).select("order_id", "month")
    changed = sets.get("orders")
    if changed is not None and changed.rows is not None:
        months = months.unionByName(_months(changed.rows))
    return months.join(named, "order_id", "left_semi").distinct()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
