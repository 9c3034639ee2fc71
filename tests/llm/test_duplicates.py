"""Exact copies, common lines, near duplicates and repeated windows against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tradewind.llm import ngram_join
from tradewind.llm.components import components
from tradewind.llm.exact_dedup import progressive_dedup
from tradewind.llm.line_dedup import LineRuns, drop_common_lines
from tradewind.llm.common import sorted_groups
from tradewind.llm.ngram_join import near_duplicates, one_of_each
from tradewind.llm.repeated_windows import drop_repeated_windows, first_digits

SCHEMA = "doc_id long, text string, kept boolean, N_LINES int, n_bytes string"


def table(spark, rows, extra=(True, 7, "x")):
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)


ODD = [(None, None), (None, ""), (1, None), (2, ""), (2, ""), (3, "a\nb"), (3, "a\nb"), (4, "a\nb"), (None, "a\nb"), (5, "x" * 300_000), (6, "x" * 300_000), (7, "é\n é \nÉ")]


def test_exact_copies(spark):
    rows = [*ODD, *[(100 + i, "same start " * 30 + str(i % 7)) for i in range(40)], *[(200 + i, "hot") for i in range(300)]]
    got = progressive_dedup(table(spark, rows), carry=["n_bytes", "kept"]).collect()
    groups = Counter(t or "" for _, t in rows)
    assert Counter((r.doc_id, r.group_size) for r in got) == Counter((i, groups[t or ""]) for i, t in rows)
    assert sum(r.kept for r in got) == len(groups)
    last = {t: max((i for i, u in rows if (u or "") == t and i is not None), default=None) for t in groups}
    assert {(r.doc_id, r.keep_id) for r in got} == {(i, last[t or ""]) for i, t in rows}
    assert all(r.kept is False or r.doc_id == r.keep_id for r in got)
    assert got[0].asDict().keys() == {"doc_id", "n_bytes", "keep_id", "group_size", "kept"}
    assert progressive_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("batches", [1, 5])
def test_common_lines(spark, batches):
    dice = random.Random(4)
    lines = [" Shared ", "shared", "SHARED\t", "É", "é", "", "rare", "Zu und."]
    rows = [*ODD, *[(50 + i, "\n".join(dice.choice(lines) for _ in range(dice.randint(1, 6))) + f"\nown {i}") for i in range(60)]]
    got = drop_common_lines(table(spark, rows), min_docs=9, batches=batches, fanout=2)
    kept = brute.kept_lines([t for _, t in rows], 9)
    want = Counter((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(k), "\n".join(k)) for (i, t), k in zip(rows, kept))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert got.columns == ["doc_id", "text", "kept", "n_bytes", "n_lines", "n_dropped", "kept_text"]
    assert drop_common_lines(table(spark, [])).count() == 0


def test_line_runs_are_compacted(spark):
    runs = LineRuns(spark, 3, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(1, 1), (batch % 2, 5)], "a long, b long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.a, r.b) for r in runs.frequent().collect()} == {(1, 1), (0, 5)}
    # what had enough documents in an earlier run is not counted any more
    assert runs.levels[0][0].filter("a = 1 and b = 1").count() == 0


def edited(dice, words, n):
    words = list(words)
    for _ in range(n):
        words[dice.randrange(len(words))] = f"w{dice.randrange(10_000)}"
    return " ".join(words)


def near_rows():
    dice = random.Random(8)
    bases = [[f"b{dice.randrange(300)}" for _ in range(size)] for size in (6, 30, 120, 400)]
    rows = [(i, edited(dice, dice.choice(bases), dice.choice([0, 0, 1, 2, 4]))) for i in range(110)]
    return [*rows, (None, "one two"), (500, "One,two"), (501, "one"), (502, "!!"), (502, "!!"), (503, None), (504, ""), (600, rows[0][1]), (600, rows[0][1])]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    rows = near_rows()
    got = near_duplicates(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got) == Counter(
        (i, *found) if brute.shingle_set(t) else (i, i, 1, 0) for (i, t), found in zip(rows, brute.near_classes(rows)))
    firsts = Counter(r.class_id for r in got if r.first_in_class)
    assert set(firsts) == {r.class_id for r in got} and all(n == 1 for i, n in firsts.items() if i != 502)
    assert near_duplicates(table(spark, [])).count() == 0


def test_one_of_each(spark):
    rows = near_rows()
    classes = brute.near_classes(rows)
    got = one_of_each(table(spark, rows))
    want = {(i if brute.shingle_set(t) else i) for (i, t), (name, _, _) in zip(rows, classes) if not brute.shingle_set(t) or i == name}
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)
    assert got.columns == ["doc_id", "text", "kept", "N_LINES", "n_bytes"]


def test_pruning_keeps_pairs_at_the_threshold():
    dice = np.random.default_rng(3)
    least, lost = ngram_join.least_matches(), 0
    for _ in range(300):
        pool = dice.integers(0, 1 << 63, 1_000).astype(np.uint64)
        size = 300
        shared = int(np.ceil(2 * size * 0.8 / 1.8))
        a, b = ngram_join.signature(pool[:size]), ngram_join.signature(pool[size - shared:2 * size - shared])
        lost += len(ngram_join.plausible_pairs(a[None], b[None], least)) == 0
    assert lost == 0
    assert least == sorted(least) and least[0] > 0


def test_components(spark):
    dice = random.Random(2)
    edges = [(dice.randrange(400), dice.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("window, gram", [(60, 16), (100, 20)])
def test_repeated_windows(spark, window, gram):
    dice = random.Random(window)
    base = ["".join(dice.choice("abcé ") for _ in range(200)) for _ in range(6)]
    texts = [None, "", "a" * 500, "a" * (window + 1), "ab" * 200, base[0], base[0]]
    texts += ["".join(dice.choice(base)[dice.randint(0, 100):dice.randint(100, 200)] for _ in range(dice.randint(0, 6))) for _ in range(120)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(5, base[0])]
    got = drop_repeated_windows(table(spark, rows), window=window, gram=gram)
    want = Counter((i, *found) for (i, _), found in zip(rows, brute.repeated_windows([t for _, t in rows], window)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got.collect()) == want
    assert got.columns == ["doc_id", "text", "kept", "N_LINES", "n_bytes", "n_removed", "n_spans", "removed_spans", "kept_bytes"]
    assert drop_repeated_windows(table(spark, [])).count() == 0


def test_very_long_text_in_segments(monkeypatch):
    from tradewind.llm import repeated_windows

    dice = random.Random(1)
    raw = bytes(dice.randrange(97, 101) for _ in range(5_000)) + b"z" * 900
    whole = first_digits(raw, 60, 16)
    monkeypatch.setattr(repeated_windows, "SEGMENT", 333)
    assert all((a == b).all() for a, b in zip(whole, first_digits(raw, 60, 16)))


def test_windows_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    got = drop_repeated_windows(docs).select("doc_id", "n_removed", F.sha2("kept_bytes", 256).alias("k")).orderBy("doc_id").collect()
    import hashlib

    want = brute.repeated_windows([r.text for r in rows], 400)
    assert [(r.doc_id, r.n_removed, r.k) for r in got] == [(r.doc_id, w[1], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, want)]


def test_copies_of_a_text_do_not_make_its_lines_common(spark):
    rows = [*[(100 + i, "first own line\nsecond own line\nlicense") for i in range(12)], *[(20 + i, f"text {i}\nLicense ") for i in range(3)]]
    rows += [*ODD, (90, None)]
    got = drop_common_lines(table(spark, rows), min_docs=4, once_per_text=True).collect()
    lost = {"license"}  # by four distinct texts; ODD has no line in four
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if brute.strip_key(x) not in lost)) for i, t in rows)
    assert Counter((r.doc_id, r.kept_text) for r in got) == want
    assert {r.n_dropped for r in got if (r.doc_id or 0) >= 100} == {1}
    assert drop_common_lines(table(spark, []), once_per_text=True).count() == 0


def test_pipeline_keeps_texts_with_many_copies(spark):
    text = "a text of its own\nwith two lines"
    docs = spark.createDataFrame([(i, text, len(text)) for i in range(15)], "doc_id long, text string, n_chars int")
    assert {r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {text}


def test_a_long_chain_is_not_compared_all_with_all(spark):
    """Texts that only resemble their neighbours: one class, links as brute force counts them, work in proportion."""
    words = [f"w{i}" for i in range(3_000)]
    rows = [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in near_duplicates(docs).collect()}
    assert [got[i] for i, _ in rows] == brute.near_classes(rows)
    classes = ngram_join.sketches(docs, "doc_id", "text").withColumn("copies", F.lit(1))
    blocks = ngram_join._survivors(classes, ngram_join.least_matches()).groupBy("bucket", "i", "j").count().cache()
    assert blocks.agg(F.max("count")).first()[0] < 60
    assert blocks.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 900 * 400


def test_sorted_groups_cross_batches():
    import pyarrow as pa

    rows = [(1, 0, "a"), (1, 0, "b"), (1, 2, "c"), (3, 2, "d"), (3, 2, "e"), (3, 2, "f"), (4, 4, "g")]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at:at + size])], ["x", "y", "z"]) for at in range(0, len(rows), size)]
        got = [(key, "".join(table.column("z").to_pylist())) for key, table in sorted_groups(iter(batches), 2)]
        assert got == [((1, 0), "ab"), ((1, 2), "c"), ((3, 2), "def"), ((4, 4), "g")]
