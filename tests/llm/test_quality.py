"""The classifier by held-out accuracy; the pipeline against plain versions of its stages; the queries of this package."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tradewind.llm import cotraining
from tradewind.llm.cotraining import _fit_logistic, _trust, features, fit, score_quality
from tradewind.llm.decontaminate import _cut_out
from tradewind.llm.common import words_of
from tradewind.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, KEPT string"


def sample(dice, i):
    """A text and whether it is good and toxic: shouted tables are bad, some words are toxic."""
    good, toxic = dice.random() < 0.7, dice.random() < 0.25
    words = [f"{dice.choice('bcdfg')}{dice.choice('aeiou')}{dice.choice('lmnr')}{dice.randrange(30)}" for _ in range(dice.randint(20, 80))]
    for _ in range(6 if toxic else 0):
        words[dice.randrange(len(words))] = dice.choice(["vilest", "horrid", "nastyish"])
    text = " ".join(words) if good else " | ".join(words).upper()
    return (i, text, dice.choice(["en", None]), f"s{dice.randrange(5)}", "x"), (i, int(good), int(toxic))


def test_held_out_accuracy(spark):
    dice = random.Random(9)
    rows, truth = zip(*[sample(dice, i) for i in range(1_500)])
    rows = [*rows, (None, None, None, None, None), (2_000, "", "en", "s1", ""), (2_000, "", "en", "s1", ""), (2_001, "word " * 60_000, "en", "s2", "")]
    labels = spark.createDataFrame([*truth[:700], (None, 1, 0), (5, None, None), (6, 7, -1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = score_quality(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "source", "p_quality", "p_toxic", "kept"] and got.count() == len(rows)
    kept = {r.doc_id: r.kept for r in got.collect()}
    held_out = truth[700:]
    right = sum(kept[i] == (good == 1 and toxic == 0) for i, good, toxic in held_out)
    assert right >= 0.97 * len(held_out)


@pytest.mark.parametrize("gap", [0.0, 3.0, 30.0, 300.0])
def test_calibration_converges_on_classes_that_nearly_separate(gap):
    """Scores as on large tables: a rare class far from the other, columns of very different scale."""
    dice = np.random.default_rng(7)
    y = (dice.random(6_500) < 0.107).astype(float)
    score = dice.normal(-4, 4, len(y)) + gap * y
    x = np.column_stack([score, score / 45, dice.normal(0, 1, len(y)), np.zeros(len(y))])
    beta = _fit_logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
    assert np.isfinite(beta).all() and abs(p.mean() - y.mean()) < 0.01
    best = max(((score > t) == y).mean() for t in np.quantile(score, np.linspace(0, 1, 500)))
    assert ((p > 0.5) == y).mean() >= best - 0.01


def small_table(spark, n=240, labelled=60):
    dice = random.Random(4)
    rows, truth = zip(*[sample(dice, i) for i in range(n)])
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("p0"), F.col("source").alias("p1"))
    return rows, docs.repartition(5), {i: (good, toxic) for i, good, toxic in truth[:labelled]}


def plain_sums(rows, entry_of):
    """Sums one document after the other; `entry_of` gives (part, target, view, class, weight) of a document."""
    sums = Counter()
    for i, text, lang, source, _ in rows:
        feats = features([text], [(lang, source)])
        for part, target, view, value, weight in entry_of(i, text, lang, source):
            buckets = feats[2 * view].tolist()
            for bucket in buckets:
                sums[part, target, value, bucket] += weight * cotraining.HALF_WEIGHT / (cotraining.HALF_WEIGHT + len(buckets))
    return sums


def assert_same_sums(got, want):
    assert set(zip(*(axis.tolist() for axis in np.nonzero(got)))) == set(want)
    assert all(abs(got[place] - value) < 1e-6 for place, value in want.items())


def test_sums_of_both_views_are_those_of_a_plain_loop(spark):
    rows, docs, known = small_table(spark)
    got = cotraining._gather(docs, known, 2, None)
    assert_same_sums(got, plain_sums(rows, lambda i, *_: [
        (cotraining._fold(i), t, view, known[i][t], 1.0) for t in (0, 1) for view in (0, 1)] if i in known else []))


def test_views_teach_each_other_what_they_are_sure_of(spark):
    rows, docs, known = small_table(spark)
    labels = spark.createDataFrame([(i, *v) for i, v in known.items()], "doc_id long, quality int, toxic int")
    model = fit(docs.withColumnsRenamed({"id": "doc_id", "p0": "lang", "p1": "source"}), labels, rounds=0)
    taught = 0

    def entries(i, text, lang, source):
        nonlocal taught
        found = []
        for t, target in enumerate(cotraining.TARGETS):
            if i in known or target not in model.both:
                continue
            by = cotraining._probabilities(model, features([text], [(lang, source)]), 1, target)
            for view in (0, 1):
                p, trust = float(by[1 - view][0]), model.trust[target][1 - view]
                value = 1 if p >= cotraining.CONFIDENT else 0 if p <= 1 - cotraining.CONFIDENT else None
                if value is not None and trust[value] > 0:
                    taught += 1
                    found.append((0, t, view, value, trust[value]))
        return found

    want = plain_sums(rows, entries)
    assert_same_sums(cotraining._gather(docs, known, 2, model), want)
    assert taught > 100  # with far fewer than 60 labels of a class


def test_trust_grows_with_the_labels_and_has_no_threshold():
    sure = lambda right, wrong: _trust(np.full(right + wrong, 0.99), np.array([1.0] * right + [0.0] * wrong))[1]
    assert sure(0, 0) == 0 and sure(1, 1) == 0 and sure(1, 5) == 0
    steps = [sure(n, 0) for n in range(200)]
    assert all(0 < b - a <= 1 / 3 + 1e-9 for a, b in zip(steps, steps[1:])) and steps[-1] > 0.98
    assert sure(97, 3) > sure(90, 10) > sure(60, 40) > 0
    assert _trust(np.array([0.01, 0.02, 0.5]), np.array([0.0, 0.0, 1.0])) == (0.5, 0.0)


def test_one_class_or_one_fold_of_labels(spark):
    rows, docs, _ = small_table(spark, 40)
    docs = docs.withColumnsRenamed({"id": "doc_id", "p0": "lang", "p1": "source"})
    one_fold = [i for i in range(40) if cotraining._fold(i) == 0]
    labels = spark.createDataFrame([(i, n % 2, 0) for n, i in enumerate(one_fold)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 40 and all(0 <= r.p_quality <= 1 and r.p_toxic == 0.5 for r in got)


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", ""), (None, None, None, None, None)], SCHEMA)
    for labels in ([], [(1, 1, 0)], [(77, 1, None)]):
        got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert [(r.kept, r.p_quality, r.p_toxic) for r in got] == [(True, 0.5, 0.5)] * 2
    assert score_quality(docs.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts, pages = [None, "", "One two two | THREE", "é É\n1", "x" * 50_000], [("en", "a")] * 5
    together = features(texts, pages)
    for i, text in enumerate(texts):
        alone = features([text], pages[:1])
        for view in (0, 2):
            assert Counter(together[view][together[view + 1] == i].tolist()) == Counter(alone[view].tolist())


@pytest.fixture(scope="module")
def stages(spark):
    from tradewind.llm.common import stored

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def test_pipeline_stages(spark, stages):
    documents, good, lines, single, clean, packed = stages
    assert all(df.columns == documents.columns for df in stages[:-1])
    rows = lambda df: sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
    kept = rows(good)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert 0.6 * documents.count() < len(kept) < documents.count()
    assert sum(i in labels and labels[i].quality == 0 for i, _, _ in kept) <= 3
    texts = ["\n".join(left) for left in brute.kept_lines([t for _, t, _ in kept], 10)]
    kept = [(i, t, len(t)) for (i, _, _), t in zip(kept, texts)]
    assert rows(lines) == kept
    classes = brute.near_classes([(i, t) for i, t, _ in kept])
    kept = [r for r, (name, _, _) in zip(kept, classes) if r[0] == name or not brute.shingle_set(r[1])]
    assert rows(single) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = []
    for (i, text, _), (places, _) in zip(kept, brute.hits([t for _, t, _ in kept], items, 10)):
        if len(places) <= 0.5 * len(words_of(text)):
            runs = [[p, p + 1] for p in sorted(places)]
            merged = []
            for s, e in runs:
                if merged and merged[-1][1] == s:
                    merged[-1][1] = e
                else:
                    merged.append([s, e])
            text = _cut_out(text, merged)
            want.append((i, text, len(text)))
    assert rows(clean) == want
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {i for i, _, _ in want}
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_run_gives_what_the_stages_give(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(map(tuple, got.select(*key).collect())) == Counter(map(tuple, stages[-1].select(*key).collect()))


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_token_shards", "op3_personal_data", "op4_quality", "op7_packing", "op8_secret_scan", "op10_repeated_windows"])
def test_queries_without_sql_cover_every_document(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got.select("doc_id").collect()} == ids
