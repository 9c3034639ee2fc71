"""Audits kept up to date from change sets: violations are kept as rows, and only what a batch touched is checked again."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..plans.requests import ChangeSet
from ..session import checkpoint_dir
from ..sources.snapshot import folder_column, read_keys
from .quality import KEY_RULES, _with_zeros, key_values, referred_values, row_rules
from .standing import named_keys

# What a violation is told by. `value` is the key of the row, the repeated value, or the parent that is missing.
NAMES = ["table_name", "rule", "column_name", "parent_table", "value"]

# Keys and values that a batch touches are broadcast up to this number, which is counted first.
NEAR = 100_000


def find_violations(t) -> DataFrame:
    """Everything that the audits count, from all rows: NAMES and `n`.

    n is the number of rows that break a row rule under this key (one, where keys are sound), of rows that share a
    value which must not repeat, or of rows that refer to a parent which is not there.
    """
    rows = [_broken(table, df).withColumn("n", F.lit(1).cast("bigint")) for table, df in t.items()]
    keys = _union([df for table in t for df in key_values(table, t[table])])
    repeated = keys.groupBy("table_name", "rule", "column_name", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    children = _union([df for table in t for df in referred_values(table, t[table])])
    parents = _union([_keys(table, t[table]) for table in dict.fromkeys(ref.parent for ref in schema.REFERENCES)])
    referred = children.groupBy("table_name", "column_name", "parent_table", "value").agg(F.count(F.lit(1)).alias("n"))
    orphans = referred.join(parents, ["parent_table", "value"], "left_anti")
    return _summed([*rows, repeated, orphans.withColumn("rule", F.lit("reference"))])


def advance_violations(violations: DataFrame, t, sets: dict[str, ChangeSet], snapshot: str | None = None) -> DataFrame:
    """The violations after a batch, from those before it, the tables before it and its change sets.

    Row rules are checked on the rows that the batch names, as they were and as they are. A key or unique column is
    looked up for values that came or went, and a parent for children that came or went; a table's rows are searched
    for children only where parents were removed. What kept its keys and references is looked up nowhere, so a batch of
    status changes reads the rows it names and no other. With `snapshot`, the folder that the tables were loaded from,
    rows are read by key from the key folders they lie in.

    Rows with no key stay: no batch can name them. A batch without changes returns the violations as they are.
    """
    sets = {table: changed for table, changed in sets.items() if changed != ChangeSet()}
    if not sets:
        return violations
    checkpoint_dir(violations.sparkSession)
    before, after = {}, {}
    for table, changed in sets.items():
        key = schema.PRIMARY_KEY[table]
        after[table] = t[table].limit(0)
        if changed.rows is not None:
            after[table] = after[table].unionByName(changed.rows, allowMissingColumns=True).checkpoint()
        named = named_keys(ChangeSet(after[table], changed.gone), key).filter(f"{key} IS NOT NULL").checkpoint()
        before[table] = _by_key(t, table, named, snapshot).checkpoint()
    rows = [_broken(table, df).withColumn("n", F.lit(sign).cast("bigint")) for side, sign in ((after, 1), (before, -1)) for table, df in side.items()]
    return _summed([violations, *rows, *_moved_keys(t, before, after), *_moved_references(violations, t, before, after, snapshot)])


def constraint_counts(violations: DataFrame) -> DataFrame:
    """`audit_constraints`, from the violations."""
    expected = [(table, kind, column) for table in schema.TABLES for kind, column, _ in row_rules(table)] + KEY_RULES
    bad = F.when(F.col("rule").isin("primary_key", "unique"), 1).otherwise(F.col("n")).cast("bigint").alias("bad")
    names = ["table_name", "rule", "column_name"]
    return _with_zeros(violations.filter("rule <> 'reference'").select(*names, bad), names, expected, "violations")


def orphan_counts(violations: DataFrame) -> DataFrame:
    """`audit_foreign_keys`, from the violations."""
    names = ["table_name", "column_name", "parent_table"]
    expected = [(ref.table, ref.column, ref.parent) for ref in schema.REFERENCES]
    return _with_zeros(violations.filter("rule = 'reference'").select(*names, F.col("n").alias("bad")), names, expected, "orphans")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _summed(frames: list[DataFrame]) -> DataFrame:
    """Signed numbers per violation; what adds up to nothing is none."""
    full = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in NAMES], "n") for df in frames]
    return _union(full).groupBy(*NAMES).agg(F.sum("n").cast("bigint").alias("n")).filter("n <> 0")


def _keys(table: str, df: DataFrame) -> DataFrame:
    return df.selectExpr(f"'{table}' AS parent_table", f"string({schema.PRIMARY_KEY[table]}) AS value")


def _broken(table: str, df: DataFrame) -> DataFrame:
    """One row per row of a table and rule that it breaks."""
    rules = ", ".join(f"struct('{kind}' AS rule, '{column}' AS column_name, {bad} AS bad)" for kind, column, bad in row_rules(table)
                      if column in df.columns or column == "item_ref")
    found = df.selectExpr(f"'{table}' AS table_name", f"string({schema.PRIMARY_KEY[table]}) AS value", f"inline(filter(array({rules}), r -> r.bad))")
    return found.drop("bad")


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= NEAR else df


def _held(df: DataFrame, *names: str) -> tuple[DataFrame, dict[tuple, int]]:
    """A frame that is read more than once, and its number of rows by names of tables and columns."""
    held = df.checkpoint()
    return held, {tuple(r)[:-1]: r.n for r in held.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}


def _by_key(t, table: str, named: DataFrame, snapshot: str | None) -> DataFrame:
    """Rows of a table with these keys."""
    key, rows, number = schema.PRIMARY_KEY[table], t[table], named.count()
    if not number:
        return rows.limit(0)
    if snapshot is not None and number <= NEAR and folder_column(table) == "part":
        rows = read_keys(named.sparkSession, snapshot, table, named, rows.columns)
    return rows.join(_near(named, number), key, "left_semi")


def _came_and_went(after: dict, before: dict, values) -> DataFrame | None:
    """How many more rows have a value after the batch; values with as many as before are left out."""
    parts = [df.withColumn("n", F.lit(sign).cast("bigint")) for side, sign in ((after, 1), (before, -1)) for table in side for df in values(table, side[table])]
    if not parts:
        return None
    return _union(parts).groupBy(*[c for c in parts[0].columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n <> 0")


def _moved_keys(t, before: dict, after: dict) -> list[DataFrame]:
    """Repeated values that the batch adds or takes away. All rows of a named primary key are among `before`."""
    names = ["table_name", "rule", "column_name", "value"]
    moved, places = _held(_came_and_went(after, before, key_values), *names[:3])
    if not places:
        return []
    searched = [df for table in before for df in key_values(table, t[table])]
    at_hand = [df for table in before for df in key_values(table, before[table])]
    by_place = dict(zip([rule for table in before for rule in KEY_RULES if rule[0] == table], zip(searched, at_hand)))
    found = _union([by_place[place][place[1] == "primary_key"] for place in places])
    counted = found.join(_near(moved.select(*names), sum(places.values())), names, "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("old"))
    old = "coalesce(old, 0)"
    return [moved.join(counted, names, "left").selectExpr(*names, f"if({old} + n > 1, {old} + n, 0) - if({old} > 1, {old}, 0) AS n")]


def _moved_references(violations: DataFrame, t, before: dict, after: dict, snapshot: str | None) -> list[DataFrame]:
    """Orphans that the batch adds or takes away."""
    place = ["parent_table", "value"]
    out = []
    reference = F.lit("reference").alias("rule")
    came, gone, parts = None, None, []
    parents = [table for table in before if any(ref.parent == table for ref in schema.REFERENCES)]
    if parents:
        was, now = (_union([_keys(table, side[table]) for table in parents]).filter("value IS NOT NULL").distinct() for side in (before, after))
        came, _ = _held(now.join(was, place, "left_anti"), "parent_table")
        gone, lost = _held(was.join(now, place, "left_anti"), "parent_table")
        # children that found their parent are known from the violations, those of a lost parent are searched for
        known = violations.filter("rule = 'reference'").join(came, place, "left_semi")
        out.append(known.withColumn("n", -F.col("n")))
        parts = [_children(t, ref) for ref in schema.REFERENCES if (ref.parent,) in lost]
    if parts:
        left = _union(parts).join(_near(gone, sum(lost.values())), place, "left_semi")
        out.append(left.groupBy("table_name", "column_name", *place).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", reference))
    moved = _came_and_went(after, before, referred_values)
    if moved is None:
        return out
    moved = moved if came is None else moved.join(came, place, "left_anti")
    moved, asked = _held(moved, "parent_table")
    if not asked:
        return out
    wanted = moved.select(*place).distinct()
    present = []
    for (parent,), number in asked.items():
        key = schema.PRIMARY_KEY[parent]
        named = wanted.filter(F.col("parent_table") == parent).select(F.col("value").cast(t[parent].schema[key].dataType).alias(key))
        present.append(_keys(parent, _by_key(t, parent, named, snapshot).select(key)))
    present = _union(present) if gone is None else _union(present).join(gone, place, "left_anti")
    out.append(moved.join(present, place, "left_anti").withColumn("rule", reference))
    return out


def _children(t, ref: schema.Reference) -> DataFrame:
    found = referred_values(ref.table, t[ref.table])
    return found[[r for r in schema.REFERENCES if r.table == ref.table].index(ref)]
