"""Audits of declared constraints and references, order reconciliation, and the effect of deletions."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..functions.money import TOTAL, platform_fee
from ..session import checkpoint_dir
from .people import setting


def row_rules(table: str) -> list[tuple[str, str, str]]:
    """(kind, column, condition under which a row breaks the rule) of one table."""
    rules = []
    for field in schema.TABLES[table]:
        name = field.name
        if field.required:
            rules.append(("not_null", name, f"{name} IS NULL"))
        limits = [f"{name} < {field.minimum}"] if field.minimum is not None else []
        limits += [f"{name} > {field.maximum}"] if field.maximum is not None else []
        if limits:
            rules.append(("check", name, " OR ".join(limits)))
        if field.allowed is not None:
            rules.append(("enum", name, f"{name} NOT IN ({', '.join(map(repr, field.allowed))})"))
        if field.length is not None:
            rules.append(("length", name, f"char_length({name}) > {field.length}"))
    if table == "cart_items":
        rules.append(("check", "item_ref", "NOT ((item_type = 'pet' AND pet_id IS NOT NULL AND product_id IS NULL)"
                                           " OR (item_type = 'product' AND product_id IS NOT NULL AND pet_id IS NULL))"))
    if table == "reviews":
        rules.append(("check", "item_ref", "NOT ((item_type = 'pet' AND pet_id IS NOT NULL)"
                                           " OR (item_type = 'product' AND product_id IS NOT NULL))"))
    return rules


def _audit_rows(table: str, df: DataFrame) -> DataFrame:
    """All row rules of a table in one pass over it, turned into one row per rule."""
    rules = [r for r in row_rules(table) if r[1] in df.columns or r[1] == "item_ref"]
    counts = df.agg(F.expr("array(" + ", ".join(f"count_if({bad})" for _, _, bad in rules) + ")").alias("counts"))
    entries = ", ".join(
        f"struct('{table}' AS table_name, '{kind}' AS rule, '{column}' AS column_name, counts[{i}] AS violations)"
        for i, (kind, column, _) in enumerate(rules)
    )
    return counts.selectExpr(f"inline(array({entries}))")


KEY_RULES = [(table, "primary_key", column) for table, column in schema.PRIMARY_KEY.items()] + [
    (table, "unique", column) for table, column in schema.UNIQUE]


def key_values(table: str, df: DataFrame) -> list[DataFrame]:
    """Values that must not repeat, one frame per key or unique column of a table."""
    return [
        df.filter(f"{column} IS NOT NULL").selectExpr(
            f"'{table}' AS table_name", f"'{rule}' AS rule", f"'{column}' AS column_name", f"string({column}) AS value")
        for owner, rule, column in KEY_RULES if owner == table
    ]


def referred_values(table: str, df: DataFrame) -> list[DataFrame]:
    """Parent keys that rows of a table name, one frame per reference."""
    return [
        df.filter(f"{ref.column} IS NOT NULL").selectExpr(
            f"'{table}' AS table_name", f"'{ref.column}' AS column_name", f"'{ref.parent}' AS parent_table",
            f"string({ref.column}) AS value")
        for ref in schema.REFERENCES if ref.table == table
    ]


def _audit_keys(t) -> DataFrame:
    """Per key or unique column, the number of values that occur more than once.

    All key columns go through one grouping, which combines map-side, instead of one shuffle each.
    """
    values = [df for table in t for df in key_values(table, t[table])]
    repeated = (
        reduce(DataFrame.unionAll, values).groupBy("table_name", "rule", "column_name", "value").count()
        .selectExpr("table_name", "rule", "column_name", "bigint(count > 1) AS bad")
    )
    return _with_zeros(repeated, ["table_name", "rule", "column_name"], KEY_RULES, "violations")


def _with_zeros(found: DataFrame, names: list[str], expected: list[tuple], result: str) -> DataFrame:
    """Sum of column bad per name, with 0 for expected names that have no rows."""
    rows = ", ".join("(" + ", ".join(map(repr, row)) + ", 0L)" for row in expected)
    zeros = found.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS ({', '.join([*names, 'bad'])})")
    return found.unionByName(zeros).groupBy(*names).agg(F.sum("bad").alias(result))


def audit_constraints(t) -> DataFrame:
    """One row per declared rule with its number of violations."""
    return reduce(DataFrame.unionByName, [*(_audit_rows(table, df) for table, df in t.items()), _audit_keys(t)])


def audit_foreign_keys(t) -> DataFrame:
    """One row per reference with the number of child rows whose parent is missing; NULL references are fine.

    Children are first counted per referenced key, so that a key many rows refer to is one row in the anti join;
    all references share one grouping and one join.
    """
    names = ["table_name", "column_name", "parent_table"]
    children = [df for table in t for df in referred_values(table, t[table])]
    parents = [
        t[table].selectExpr(f"'{table}' AS parent_table", f"string({schema.PRIMARY_KEY[table]}) AS value")
        for table in dict.fromkeys(ref.parent for ref in schema.REFERENCES)
    ]
    counted = reduce(DataFrame.unionAll, children).groupBy(*names, "value").agg(F.count(F.lit(1)).alias("bad"))
    orphans = counted.join(reduce(DataFrame.unionAll, parents), ["parent_table", "value"], "left_anti")
    expected = [(ref.table, ref.column, ref.parent) for ref in schema.REFERENCES]
    return _with_zeros(orphans.select(*names, "bad"), names, expected, "orphans")


def reconcile_orders(t) -> DataFrame:
    """Per order: lines against total, fee and payout against the current fee, and payment against total."""
    zero = F.lit(0).cast(TOTAL)
    sums = t["order_items"].groupBy("order_id").agg(F.sum("subtotal").cast(TOTAL).alias("line_total"))
    paid = t["payments"].select("order_id", F.col("amount").alias("payment_amount"))
    rows = (
        t["orders"].select("order_id", "total_price", "shipping_cost", "platform_fee", "seller_payout")
        .join(sums, "order_id", "left").join(paid, "order_id", "left")
        .withColumn("line_total", F.coalesce("line_total", zero))
        .withColumn("expected_fee", platform_fee(F.col("line_total"), setting(t, "platform_fee_percent")))
    )
    return rows.select(
        "order_id", "line_total", "expected_fee",
        (F.col("line_total") == F.col("total_price") - F.col("shipping_cost")).alias("lines_match"),
        (F.col("expected_fee") == F.col("platform_fee")).alias("fee_matches"),
        (F.col("seller_payout") == F.col("total_price") - F.col("shipping_cost") - F.col("platform_fee"))
        .alias("payout_matches"),
        F.col("payment_amount").isNotNull().alias("has_payment"),
        F.coalesce(F.col("payment_amount") == F.col("total_price"), F.lit(False)).alias("payment_matches"),
    )


def propagate_delete(t, parent: str, keys: DataFrame) -> DataFrame:
    """What deleting rows of a table entails: (table_name, row_key, action, column_name).

    keys has one column of parent keys. A key with a restricting child is not deleted: it comes back as action
    'blocked' and nothing below it is touched. Otherwise the row itself and its cascading children, at any
    depth, are 'delete', and references to be cleared are 'set_null' with their column. A child reached on two
    ways is reported once, as deleted when either way deletes it.

    Lists of deleted parents are used once per child table, so each is checkpointed instead of recomputed.
    """
    checkpoint_dir(keys.sparkSession)
    existing = t[parent].select(F.col(schema.PRIMARY_KEY[parent]).alias("row_key"))
    doomed = existing.join(keys.toDF("row_key").distinct(), "row_key", "left_semi")
    holders = [
        t[ref.table].select(F.col(ref.column).alias("row_key")).join(doomed, "row_key", "left_semi").distinct()
        for ref in schema.REFERENCES if ref.parent == parent and ref.on_delete == "restrict"
    ]
    parts = []
    if holders:
        blocked = reduce(DataFrame.unionByName, holders).distinct().checkpoint()
        doomed = doomed.join(blocked, "row_key", "left_anti")
        parts.append(_effect(parent, blocked, "blocked"))

    deleted, cleared, waiting = {parent: doomed}, [], [parent]
    while waiting:
        current = waiting.pop(0)
        below = [ref for ref in schema.REFERENCES if ref.parent == current and ref.on_delete != "restrict"]
        if below:
            deleted[current] = deleted[current].checkpoint()
        for ref in below:
            gone = deleted[current].select(F.col("row_key").alias(ref.column))
            hit = (
                t[ref.table].join(gone, ref.column, "left_semi")
                .select(F.col(schema.PRIMARY_KEY[ref.table]).alias("row_key"))
            )
            if ref.on_delete == "set_null":
                cleared.append((ref, hit))
            elif ref.table in deleted:
                deleted[ref.table] = deleted[ref.table].unionByName(hit).distinct()
            else:
                deleted[ref.table] = hit
                waiting.append(ref.table)
    parts += [_effect(table, rows, "delete") for table, rows in deleted.items()]
    for ref, rows in cleared:
        if ref.table in deleted:
            rows = rows.join(deleted[ref.table], "row_key", "left_anti")
        parts.append(_effect(ref.table, rows, "set_null", ref.column))
    return reduce(DataFrame.unionByName, parts)


def _effect(table: str, rows: DataFrame, action: str, column: str | None = None) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table_name"), F.col("row_key").cast("string").alias("row_key"),
        F.lit(action).alias("action"), F.lit(column).cast("string").alias("column_name"),
    )
