"""Trigram lists: the same rows as the scan, whatever the pattern; only the rows of one list are read."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import tables
from tradewind.functions import contains
from tradewind.operators import catalog, people
from tradewind.plans.requests import ChangeSet
from tradewind.sources import TextIndex, load_marketplace, text_index, write_snapshot
from tradewind.sources.text_index import needle_grams

NAMES = ["bowl", "Red BOWL", "red%bowl", "a_b_c", "50% off", "back\\slash", "aaaa", "", "ab", None, "ÄÖÜ straße", "ΑΣ", "ΑΣΑΣ", "İstanbul",
         "line\nbreak", "emoji 🐈🐈🐈", "red bowl", "x" * 3_000 + "needle", "bowl bowl bowl"]
NEEDLES = ["bowl", "RED", "red bowl", "r%d", "red%wl", "r_d b", "a", "ab", "_", "%", "___", "aaa", "no such", "0\\% o", "d\\%b", "k\\\\sl", "äöü", "STRASSE",
           "straße", "ΑΣ", "ασα", "istan", "e\nb", "🐈🐈🐈", "needle", "l b%l b", "%%bowl%%"]


def products(spark, names):
    return tables(spark, products=[{"product_id": f"p{i}", "product_name": name} for i, name in enumerate(names)],
                  users=[{"user_id": "s1", "name": "Ann Onym", "email": "ann@x.org"}, {"user_id": "u2", "name": None, "email": "onyx@x.org"}])


def ids(df, key="product_id"):
    return sorted(r[0] for r in df.select(key).collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    t = products(spark, NAMES)
    write_snapshot({name: t[name] for name in ("products", "users")}, f"{path}/snapshot")
    t = {**t, **load_marketplace(spark, f"{path}/snapshot", tables=("products", "users"))}
    index = TextIndex(spark, f"{path}/index")
    index.replace({name: t[name] for name in ("products", "users")})
    return t, index, f"{path}/snapshot"


@pytest.mark.parametrize("needle", NEEDLES)
def test_same_rows_as_the_scan(indexed, needle):
    t, index, snapshot = indexed
    expected = ids(t["products"].filter(contains("product_name", needle)))
    narrowed = index.narrowed(t, "products", {"product_name": needle}, snapshot=snapshot)["products"]
    assert narrowed.columns == t["products"].columns
    assert ids(narrowed.filter(contains("product_name", needle))) == expected
    found = index.keys("products", "product_name", needle)
    if found is not None:
        assert set(ids(found[0])) == set(expected) and found[1] >= len(expected)


def test_random_texts_and_patterns(spark, tmp_path):
    dice = random.Random(5)
    text = lambda n: "".join(dice.choice("abAB%_ ") for _ in range(n))
    t = products(spark, [text(dice.randint(0, 12)) for _ in range(400)])
    index = TextIndex(spark, str(tmp_path))
    index.replace({"products": t["products"]})
    for _ in range(12):
        needle = text(dice.randint(1, 6))
        kept = index.narrowed(t, "products", {"product_name": needle})["products"]
        assert ids(kept.filter(contains("product_name", needle))) == ids(t["products"].filter(contains("product_name", needle))), needle


def test_trigrams_of_a_pattern(spark):
    assert needle_grams(spark, "Red%bo_l") == ["red"]
    assert needle_grams(spark, "a%bc_d") == []
    assert needle_grams(spark, "0\\% o") == ["% o", "0% "]
    assert needle_grams(spark, "a\\b") is None
    assert needle_grams(spark, "abc\\") == ["abc", "bc%"]  # the filter's own % is escaped by it


def test_a_search_reads_one_list_and_the_folders_of_what_it_finds(indexed):
    t, index, snapshot = indexed
    keys, bound = index.keys("products", "product_name", "needle")
    assert bound == 1
    plan = keys._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(gram," in scan and "field" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    narrowed = index.narrowed(t, "products", {"product_name": "needle"}, snapshot=snapshot)["products"]
    plan = narrowed._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan and "LeftSemi" in plan


def test_a_list_of_most_rows_is_no_help(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "NEAR", 3)
    t = products(spark, ["common name"] * 40 + ["common rare", "commonly"] * 2)
    index = TextIndex(spark, str(tmp_path))
    index.replace({"products": t["products"]})
    assert index.keys("products", "product_name", "common") is None
    assert index.narrowed(t, "products", {"product_name": "common"})["products"] is not None
    keys, bound = index.keys("products", "product_name", "rare")
    assert bound == 2 and len(ids(keys)) == 2
    many = index.narrowed(t, "products", {"product_name": "name"})["products"].filter(contains("product_name", "name"))
    assert many.count() == 40
    monkeypatch.setattr(text_index, "SCAN_SHARE", 1)  # now the long list is joined without a broadcast
    longer = index.narrowed(t, "products", {"product_name": "common"})["products"]
    assert "ResolvedHint" not in longer._jdf.queryExecution().analyzed().toString() and longer.count() == 44


def test_changes_are_found_and_old_texts_are_not(spark, tmp_path):
    t = products(spark, ["bowl", "plate", "cup"])
    index = TextIndex(spark, str(tmp_path))
    index.add({"products": t["products"]}, "first")
    renamed = t["products"].filter("product_id = 'p0'").withColumn("product_name", F.lit("vase"))
    gone = t["products"].filter("product_id = 'p2'").select("product_id")
    sets = {"products": ChangeSet(renamed, gone)}
    index.add_changes(sets, "second")
    index.add_changes(sets, "second")  # again
    after = {**t, "products": t["products"].filter("product_id = 'p1'").unionByName(renamed)}
    search = lambda needle: ids(catalog.admin_products(index.narrowed(after, "products", {"product_name": needle}),
                                                       catalog.ItemFilters(search=needle), page=None))
    assert search("vase") == ["p0"] and search("bowl") == [] and search("cup") == [] and search("plat") == ["p1"]
    assert len(index.segments()) == 2


def test_segments_are_merged(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    names = [f"item number {i:02d}" for i in range(text_index.FANOUT)]
    t = products(spark, names)
    for i in range(len(names)):
        index.add({"products": t["products"].filter(f"product_id = 'p{i}'")}, str(i))
    assert [(s.level, s.rows["products.product_name"]) for s in index.segments()] == [(1, len(names))]
    index.add({"products": t["products"].filter("product_id = 'p0'")}, "0")  # a retry of a merged batch
    assert len(index.segments()) == 1
    assert ids(index.keys("products", "product_name", "number 05")[0]) == ["p5"]


def test_name_or_address(indexed):
    t, index, snapshot = indexed
    both = index.narrowed(t, "users", {"name": "ony", "email": "ony"}, any_of=True, snapshot=snapshot)
    assert ids(people.list_users(both, people.UserFilters(search="ony"), page=None), "user_id") == ids(
        people.list_users(t, people.UserFilters(search="ony"), page=None), "user_id") == ["s1", "u2"]
    short = index.narrowed(t, "users", {"name": "on", "email": "ony"}, any_of=True)
    assert short["users"] is t["users"]


def test_nothing_indexed(spark, tmp_path):
    t = products(spark, [])
    index = TextIndex(spark, str(tmp_path))
    assert index.keys("products", "product_name", "bowl") is None
    index.replace({"products": t["products"]})
    assert index.keys("products", "product_name", "bowl")[0].count() == 0
    assert index.narrowed(t, "products", {"product_name": None, "image_url": ""})["products"].columns == t["products"].columns


def test_a_task_sorts_a_bounded_number_of_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "POSTINGS_PER_FILE", 20)
    t = products(spark, [f"name {i:04d}" for i in range(60)])
    index = TextIndex(spark, str(tmp_path))
    index.replace({"products": t["products"]})
    lists = spark.read.parquet(f"{index.path}/*/postings").withColumn("_file", F.input_file_name())
    files = [r["count"] for r in lists.groupBy("_file").count().collect()]
    assert len(files) > 10 and max(files) < 80 and sum(files) == 60 * 7 - 1  # "0000" holds one gram twice
    assert ids(index.narrowed(t, "products", {"product_name": "0042"})["products"].filter(contains("product_name", "0042"))) == ["p42"]
