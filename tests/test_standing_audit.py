"""Violations moved on by change sets equal audits of all rows."""

import random

from fixtures import rows_of, tables
from test_standing import batches, kept, world
from tradewind import schema
from tradewind.operators import quality, standing_audit as audit
from tradewind.plans.requests import ChangeSet
from tradewind.sources import load_marketplace, write_snapshot


def patched(t, sets):
    """The tables after a batch, the plain way."""
    out = dict(t)
    for table, changed in sets.items():
        key = schema.PRIMARY_KEY[table]
        for df in changed:
            if df is not None:
                out[table] = out[table].join(df.select(key), key, "left_anti")
        if changed.rows is not None:
            out[table] = out[table].unionByName(changed.rows, allowMissingColumns=True)
    return out


def same_audits(t, state):
    assert rows_of(state, *audit.NAMES, "n") == rows_of(audit.find_violations(t), *audit.NAMES, "n")
    for got, want in ((audit.constraint_counts(state), quality.audit_constraints(t)), (audit.orphan_counts(state), quality.audit_foreign_keys(t))):
        assert got.columns == want.columns
        assert rows_of(got, *got.columns) == rows_of(want, *want.columns)


def some_row(dice, table, key):
    """A row that may break any rule: keys and references come from few values, some of which are nowhere."""
    one = lambda prefix: dice.choice([None, *[f"{prefix}{i}" for i in range(5)]])
    return {
        "users": {"user_id": key, "email": dice.choice(["x", "y", None, f"mail {key}"]), "name": "N" * dice.choice([1, 300]), "role": dice.choice(["buyer", "god"])},
        "categories": {"category_id": int(key[1:]), "name": dice.choice(["a", "b", "c", "d"])},
        "products": {"product_id": key, "seller_id": one("u"), "category_id": dice.choice([None, 0, 1, 2, 9]), "stock": dice.choice([-1, 3])},
        "pets": {"pet_id": key, "seller_id": one("u")},
        "orders": {"order_id": key, "buyer_id": one("u"), "status": dice.choice(["pending", "lost"])},
        "payments": {"payment_id": key, "order_id": one("o")},
        "reviews": {"review_id": key, "reviewer_id": one("u"), "item_type": "product", "pet_id": one("p"), "product_id": one("r"), "rating": dice.choice([0, 5, 6])},
    }[table]


LETTERS = {"users": "u", "categories": "c", "products": "r", "pets": "p", "orders": "o", "payments": "m", "reviews": "v"}


def some_rows(spark, dice, table, number):
    chosen = dice.sample(range(7), number)
    made = tables(spark, **{table: [some_row(dice, table, f"{LETTERS[table]}{i}") for i in chosen]})
    return made[table]


def test_random_changes(spark):
    dice = random.Random(1)
    t = kept({**tables(spark), **{table: some_rows(spark, dice, table, 5) for table in LETTERS}})
    state = audit.find_violations(t).checkpoint()
    assert state.count()
    for _ in range(3):
        sets = {}
        for table in dice.sample(sorted(LETTERS), 4):
            key = schema.PRIMARY_KEY[table]
            gone = [some_row(dice, table, f"{LETTERS[table]}{i}")[key] for i in dice.sample(range(7), 2)]
            of = spark.createDataFrame([(g,) for g in gone], f"{key} {schema.TABLES[table][0].type}")
            rows = some_rows(spark, dice, table, 3)
            sets[table] = dice.choice([ChangeSet(rows), ChangeSet(gone=of), ChangeSet(rows.join(of, key, "left_anti"), of)])
        state = audit.advance_violations(state, t, sets).checkpoint()
        t = kept(patched(t, sets))
    same_audits(t, state)


def test_batches_of_the_operators(spark):
    t = world(spark)
    state = audit.find_violations(t).checkpoint()
    for batch in batches(spark):
        change = batch(t)
        state = audit.advance_violations(state, t, change.sets).checkpoint()
        t = {**t, **kept({name: df for name, df in change.tables.items() if name in change.sets})}
    same_audits(t, state)


def test_repeated_and_missing_keys(spark):
    """Rows that share a key are replaced together, rows without one stay, and a batch may bring both."""
    users = [{"user_id": k, "email": e} for k, e in [("u0", "a"), ("u0", "a"), (None, "a"), (None, "b"), ("u1", "b")]]
    t = kept(tables(spark, users=users, pets=[{"pet_id": "p", "seller_id": s} for s in ("u0", "u1", "zz", None)]))
    state = audit.find_violations(t).checkpoint()
    rows = tables(spark, users=[{"user_id": "u0", "email": "b"}, {"user_id": None, "email": "c"}, {"user_id": "u2"}, {"user_id": "u2"}])["users"]
    sets = {"users": ChangeSet(rows, spark.createDataFrame([("u1",), (None,), ("no",)], "user_id string")), "pets": ChangeSet()}
    after = {**t, "users": t["users"].filter("user_id IS NULL").unionByName(rows)}
    state = audit.advance_violations(state, t, sets).checkpoint()
    same_audits(after, state)
    assert audit.advance_violations(state, after, {"users": ChangeSet()}) is state


def test_empty_tables(spark):
    t = tables(spark)
    state = audit.find_violations(t)
    assert state.count() == 0
    same_audits(t, state)
    rows = tables(spark, pets=[{"pet_id": "p", "seller_id": "nobody"}])["pets"]
    same_audits({**t, "pets": rows}, audit.advance_violations(state, t, {"pets": ChangeSet(rows)}))


def test_many_touched_values_are_joined_without_a_broadcast(spark, monkeypatch):
    dice = random.Random(9)
    t = kept({**tables(spark), **{table: some_rows(spark, dice, table, 5) for table in LETTERS}})
    state = audit.find_violations(t).checkpoint()
    sets = {"users": ChangeSet(some_rows(spark, dice, "users", 4)), "pets": ChangeSet(some_rows(spark, dice, "pets", 4))}
    monkeypatch.setattr(audit, "NEAR", 0)
    same_audits(patched(t, sets), audit.advance_violations(state, t, sets))


def test_only_what_the_batch_touched_is_read(spark, tmp_path):
    """With a snapshot, rows are looked up in the key folders of the batch; a change of no key looks up nothing else."""
    t = kept(tables(spark, users=[{"user_id": f"u{i}", "email": f"e{i}", "name": "n"} for i in range(5)],
                    pets=[{"pet_id": f"p{i}", "seller_id": "u1"} for i in range(5)], reviews=[{"review_id": "v", "reviewer_id": "u2", "item_type": "pet", "pet_id": "p1", "rating": 1}]))
    write_snapshot(t, str(tmp_path))
    loaded = load_marketplace(spark, str(tmp_path))
    state = audit.find_violations(loaded).checkpoint()
    # tables that must not be read are empty
    gone = {table: spark.createDataFrame([], df.schema) for table, df in loaded.items()}
    only = {**gone, "pets": loaded["pets"]}
    stock = t["pets"].filter("pet_id = 'p1'").selectExpr(*[c if c != "stock" else "int(-4) AS stock" for c in t["pets"].columns])
    moved = audit.advance_violations(state, only, {"pets": ChangeSet(stock)}, str(tmp_path)).checkpoint()
    assert rows_of(moved, "table_name", "rule", "column_name", "value", "n") == [("pets", "check", "stock", "p1", 1)]
    new = tables(spark, pets=[{"pet_id": "p9", "seller_id": "u4"}, {"pet_id": "p8", "seller_id": "none"}])["pets"]
    moved = audit.advance_violations(state, loaded, {"pets": ChangeSet(new)}, str(tmp_path))
    assert rows_of(moved, "rule", "parent_table", "value") == [("reference", "users", "none")]
    same_audits(patched(t, {"pets": ChangeSet(new)}), moved)
