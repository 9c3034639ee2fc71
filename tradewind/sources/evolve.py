"""Additive schema changes and insert-if-absent."""

from pyspark.sql import DataFrame, functions as F

from .. import schema


def evolve_schema(df: DataFrame, table: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Adds the declared columns a table does not have yet; existing columns keep their place, type and values."""
    defaults = defaults or {}
    missing = {
        field.name: F.lit(defaults.get(field.name, field.default)).cast(field.type)
        for field in schema.TABLES[table] if field.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def insert_if_absent(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Current rows plus the new rows whose key is not present; of equal new keys one row is kept.

    The absent rows are reduced to the smallest one per key, which combines map-side.
    """
    rest = [c for c in new.columns if c != key]
    row = F.struct(*rest) if rest else F.lit(None)
    absent = new.join(current.select(key), key, "left_anti").groupBy(key).agg(F.min(row).alias("_row"))
    picked = absent.select(key, *[F.col("_row").getField(c).alias(c) for c in rest])
    return current.unionByName(picked, allowMissingColumns=True)
