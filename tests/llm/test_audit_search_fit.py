"""Filter audit, lexical search and best-fit packing against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm import best_fit, filter_audit, lexical_search
from tradewind.llm.common import words_of
from tradewind.llm.tokens import tokenizer_path

# --- filter audit


def test_lehmer_ranks_and_intervals():
    for k in (1, 3, 5):
        orders = list(permutations(range(k)))
        assert [filter_audit.lehmer_rank(o, k) for o in orders] == list(range(len(orders)))
        for mask in range(1 << k):
            step_of = [next((i + 1 for i, f in enumerate(o) if mask >> f & 1), None) for o in orders]
            got = [None] * len(orders)
            found = filter_audit.removal_intervals(mask, k)
            for step, start, end in found:
                assert got[start:end] == [None] * (end - start)
                got[start:end] = [step] * (end - start)
            assert got == step_of
            for (step, _, end), (later, start, _) in zip(found, found[1:]):
                assert step != later or end < start  # neighbours are joined


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words = text.translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails.add("E")
        parts[lang or ""].append((i, fails))
    out = []
    for part, docs in parts.items():
        lines = []
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, letter in enumerate(order, 1):
                removed = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = sum(letter in d[1] for d in docs)
                lines.append([part, "".join(order), step, len(left), len(removed), failing - len(removed),
                              sum(d[1] == {letter} for d in docs), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)])
        total = Counter()
        for line in lines:
            total[line[1][line[2] - 1]] += line[4]
        out += [(*line, total[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, monkeypatch):
    dice = random.Random(11)
    long = " ".join(f"w{i}" for i in range(120))
    pool = [long, long + " $", long.upper(), "x " * 150, "", None, "a b", "É" * 30 + "AB", long + "\n\t " + long, "w\x0b\x0c\rv x0a0y", " "]
    rows = [(i, dice.choice(pool), dice.choice(["en", "de", "", None])) for i in range(200)]
    rows += [(7, rows[7][1], "en"), (None, long, "en"), (None, long, None), (None, "alone", "fr"), (500, " ".join(f"v{i}" for i in range(400)), "xx")]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, 5])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, part string, MASK int").repartition(5)
    marked = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    for size in (4 << 20, 10):  # the second way of splitting texts
        monkeypatch.setattr(filter_audit, "LONG_TEXT", size)
        got = filter_audit.audit_filters(docs, marked)
        assert got.columns == COLUMNS
        assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), marked).count() == 0
    assert filter_audit.audit_filters(docs, marked.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_of_a_hot_text(spark):
    """A text that a third of the rows have, in one language: sums in the map tasks, no gathered group."""
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same")
                                     .otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("en").alias("lang")).repartition(6)
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit_filters(docs, labels).collect()}
    assert len(rows) == 600
    first = rows["EABCD", 1]
    assert (first.removed, first.kept, first.good_lost, first.toxic_lost, first.unique_fails) == (2_999, 6_001, 1, 1, 0)
    assert rows["AEBCD", 2].redundant == 2_999 and rows["AEBCD", 1].removed == 9_000


# --- lexical search


def plain_search(docs, items, k):
    """docs: (doc_id, text); items: (item_id, text)."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in words_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block_words, vocabulary, seeds, tree", [(10_000, 10_000, 40, 4096), (25, 3, 1, 37), (8, 10_000, 10_000, 16)])
def test_search(spark, monkeypatch, block_words, vocabulary, seeds, tree):
    for name, value in (("VOCABULARY", vocabulary), ("SEED_DOCS", seeds), ("TREE_DOCS", tree), ("LEAF_DOCS", 3), ("STRETCH", 50)):
        monkeypatch.setattr(lexical_search, name, value)
    dice = random.Random(block_words)
    word = lambda: dice.choice(["a", "B", "the", "é", f"w{int(dice.paretovariate(0.7)) % 90}"])
    text = lambda n: dice.choice([" ", "-", "  "]).join(word() for _ in range(n))
    docs = [(i, text(dice.randint(0, 40))) for i in range(300)]
    docs += [(900 + i, docs[5][1]) for i in range(20)] + [(5, docs[5][1]), (None, docs[6][1]), (901, None), (902, "!?"), (903, "a " * 500)]
    items = [(i, text(dice.randint(0, 15))) for i in range(25)] + [(3, "a the w1"), (None, "w2 w2 w3"), (40, None), (41, ""), (42, "unseen words"), (43, docs[5][1])]
    dice.shuffle(docs)
    frame = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, rank string, n int").repartition(4)
    wanted = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int").repartition(3)
    got = lexical_search.search(frame, wanted, k=7, block_words=block_words)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_search(docs, items, 7)


def test_search_of_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("x", "One!")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical_search.search(docs, items).orderBy("rank").collect()] == [("x", 1, "a"), ("x", 2, "b"), ("x", 3, None)]
    for some, other in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 'z'"), items.limit(0))):
        found = lexical_search.search(some, other)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_the_two_trees_prune_and_bound():
    """Maxima bound what lies below, and most pairs of an item and a document are never scored."""
    dice = np.random.default_rng(3)
    n_docs, n_items, width = 3_000, 60, 400
    topic = lambda: dice.integers(0, 20)
    words = lambda t, n: [int(x) for x in (t * 20 + dice.integers(0, 20, n))]
    docs = [Counter(words(topic(), 30)) for _ in range(n_docs)]
    items = [(i, [f"{t:03d}" for t in set(words(topic(), 12))]) for i in range(n_items)]
    block = lexical_search.ItemBlock([(i, ts, [1] * len(ts)) for i, ts in items], {f"{t:03d}": 3000 + t for t in range(width)}, n_docs, n_docs * 30)
    best = lexical_search.Best(n_items, 10)
    search = lexical_search.DualTreeSearch(block, best)
    every = np.zeros((n_docs, n_items), np.int64)
    for at in range(0, n_docs, 1000):
        part = docs[at:at + 1000]
        known = [{block.vocabulary[f"{t:03d}"]: n for t, n in d.items() if f"{t:03d}" in block.vocabulary} for d in part]
        starts = np.concatenate(([0], np.cumsum([len(d) for d in known])))
        terms = np.array([t for d in known for t in d], np.int64)
        tf = np.array([n for d in known for n in d.values()], np.int64)
        owner = np.repeat(np.arange(len(part)), [len(d) for d in known])
        values = lexical_search.impacts(tf, np.full(len(part), 30), owner, n_docs, n_docs * 30)
        tree = lexical_search.build_tree(starts, terms, values, values.astype(float), len(block.vocabulary), 16)
        dense = np.zeros((len(part), len(block.vocabulary)), np.int64)
        dense[owner, terms] = values
        for node in range(len(tree.begin)):
            rows = tree.order[tree.begin[node]:tree.end[node]]
            assert (tree.maxima[node] == dense[rows].max(axis=0)).all()
        assert sorted(tree.order.tolist()) == list(range(len(part)))
        search.add(list(range(at, at + len(part))), starts, terms, values)
        for leaf, item in enumerate(block.item.tolist()):
            if not block.left[leaf]:
                weight = np.zeros(len(block.vocabulary), np.int64)
                weight[block.coordinates[leaf]] = block.values[leaf]
                every[at:at + len(part), item] = dense @ weight
    for item in range(n_items):
        order = sorted(range(n_docs), key=lambda d: (-every[d, item], d))[:10]
        assert [(-s, i) for s, _, i in best.lists[item]] == [(int(every[d, item]), d) for d in order if every[d, item] > 0]
    assert search.scored < n_docs * n_items / 4
    assert search.bounds < n_docs * n_items / 4


# --- best fit


def plain_best_fit(histogram, size):
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = [b for b in bins if b[0] >= length]
            if fitting:
                chosen = min(fitting, key=lambda b: b[0])
            else:
                chosen = [size, []]
                bins.append(chosen)
            chosen[0] -= length
            chosen[1].append(length)
    return bins


def test_best_fit_equals_one_by_one():
    for seed in range(150):
        dice = random.Random(seed)
        size = dice.choice([1, 5, 10, 64, 100])
        histogram = dict(Counter(dice.choice([dice.randint(1, size), (size + 1) // 2]) for _ in range(dice.randint(0, 200))))
        got = best_fit.best_fit_decreasing(histogram, size)
        used = Counter()
        for count, lengths in got:
            assert count > 0 and sum(n * times for n, times in lengths) <= size
            used.update({n: count * times for n, times in lengths})
        assert used == histogram
        room = Counter({})
        for count, lengths in got:
            room[size - sum(n * times for n, times in lengths)] += count
        assert room == Counter(b[0] for b in plain_best_fit(histogram, size))
    # 6 opens, 5 opens, 4 goes to the 6 (room 4, the tightest), 3 to the 5, 2 fills it
    assert sorted(best_fit.best_fit_decreasing({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == [(1, [(5, 1), (3, 1), (2, 1)]), (1, [(6, 1), (4, 1)])]


def test_room_tree():
    dice = random.Random(2)
    for size in (1, 2, 7, 64):
        tree, there = best_fit.RoomTree(size), set()
        for _ in range(300):
            room = dice.randint(0, size)
            tree.set(room, room not in there)
            there ^= {room}
            least = dice.randint(0, size)
            assert tree.tightest(least) == min((r for r in there if r >= least), default=None)


def test_runs_stay_within_the_bound():
    dice = random.Random(9)
    histogram = {n: int(10 ** dice.uniform(0, 12)) for n in range(1, 2049)}
    patterns = best_fit.best_fit_decreasing(histogram, 2048)
    assert len(patterns) <= 4 * 2048
    runs = best_fit._runs(patterns)
    assert sum(r.nbytes for r in runs.values()) <= 4 * 2048 * 64 * 32
    even = best_fit.best_fit_decreasing({n: 1000 for n in range(1, 2049)}, 2048)
    assert sum(count for count, _ in even) <= 1.001 * 1000 * sum(range(1, 2049)) / 2048


def test_pack_best_fit(spark):
    dice = random.Random(4)
    rows = [(7, "alpha beta  gamma"), (3, None), (3, ""), (None, "no id"), (1, "x " * 9_000), (2, "tie"), (2, "tie")]
    rows += [(100 + i, "word " * dice.choice([3, 3, 3, dice.randint(0, 300)])) for i in range(200)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, start string, LENGTH int").repartition(5)
    name = tokenizer_path("word_bpe_49k.json")
    got = best_fit.pack_best_fit(docs, name, True, 0, size=128).collect()
    tool = Tokenizer.from_file(name)
    want = [(i, np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]
    pieces = Counter((i, p, start, len(ids[start:start + 128]), zlib.crc32(ids[start:start + 128].tobytes()))
                     for i, ids in want for p, start in enumerate(range(0, len(ids), 128)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    histogram = Counter(length for (_, _, _, length, _), n in pieces.items() for _ in range(n))
    assert len(sequences) == len(plain_best_fit(histogram, 128))
    assert best_fit.pack_best_fit(docs.limit(0), name, True, 0).count() == 0
    texts = spark.createDataFrame([("b", "one"), ("a", None)], "name string, body string")
    packed = best_fit.pack_best_fit(texts, name, True, 0, id_col="name", text_col="body")
    assert {r.name for r in packed.collect()} == {"a", "b"} and packed.columns[0] == "name"
