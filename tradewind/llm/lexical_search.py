"""The best documents for each of many queries by exact integer BM25: dual-tree search over queries and documents."""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tradewind.llm.common import slices, stored, words_of

# Fixed values of the score: weights in thousandths, tf saturation 8 / 1000, length share 75 %.
_SCALE, _GAIN, _TF, _NORM, _SHARE = 1000, 1_000_000_000, 1000, 8, 75
BLOCK_WORDS = 16_384  # words of the items that one search holds; more items take more searches
VOCABULARY = 1_000_000  # item terms that the text pass is told; beyond it keeps every term of a document
TREE_DOCS, LEAF_DOCS = 4096, 16  # documents under one tree, and in a leaf
TREE_TERMS = 2_000_000  # terms under one tree
STRETCH = 4 << 20  # characters that are split into words at once
SEED_DOCS = 8192  # documents that are searched first, for scores that others must reach
SALTS = 64


@dataclass
class Tree:
    """A binary hierarchy over rows of coordinates. Node 0 is the root, children come after their parent.

    `order` lists the rows so that node i covers order[begin[i]:end[i]]; `left` and `right` are 0 in a leaf.
    `maxima` has the largest value of each coordinate among the rows of a node.
    """

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    maxima: np.ndarray


def _entries(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of `rows`, and for each the number of its row among them."""
    sizes = starts[rows + 1] - starts[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[rows], sizes), owner


def _halves(rows: np.ndarray, starts: np.ndarray, terms: np.ndarray, spread: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts rows at the mean of the coordinate that varies most; in the middle of its order where that is lopsided."""
    places, owner = _entries(starts, rows)
    if not len(places):
        return np.array_split(rows, 2)
    used, values = terms[places], spread[places]
    if width > 4 * len(used):
        names, used = np.unique(used, return_inverse=True)
        width = len(names)
    sums = np.bincount(used, values, width)
    widest = int(np.argmax(np.bincount(used, values * values, width) - sums * sums / len(rows)))
    found = used == widest
    value = np.zeros(len(rows))
    value[owner[found]] = values[found]
    order = np.argsort(-value, kind="stable")
    cut = int((value > sums[widest] / len(rows)).sum())
    if not len(rows) // 8 < cut < len(rows) - len(rows) // 8:
        cut = len(rows) // 2
    return rows[order[:cut]], rows[order[cut:]]


def build_tree(starts: np.ndarray, terms: np.ndarray, values: np.ndarray, spread: np.ndarray, width: int, leaf: int) -> Tree:
    """Hierarchy over rows given as starts, terms and values; `spread` (the values, weighted) decides the cuts."""
    begin, end, left, right, order = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        node = len(begin)
        begin.append(len(order))
        for column in (end, left, right):
            column.append(0)
        if len(rows) > leaf:
            one, other = _halves(rows, starts, terms, spread, width)
            left[node], right[node] = grow(one), grow(other)
        else:
            order.extend(rows.tolist())
        end[node] = len(order)
        return node

    grow(np.arange(len(starts) - 1))
    order = np.array(order, np.int64)
    maxima = np.zeros((len(begin), width), values.dtype)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for node in range(len(begin) - 1, -1, -1):
        if left[node]:
            np.maximum(maxima[left[node]], maxima[right[node]], out=maxima[node])
        else:
            places, _ = _entries(starts, order[begin[node]:end[node]])
            np.maximum.at(maxima[node], terms[places], values[places])
    return Tree(order, *(np.array(c, np.int64) for c in (begin, end, left, right)), maxima)


class ItemBlock:
    """Items as weighted coordinates with their tree, and what the documents' impacts need. Made on the driver."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]], weights: dict[str, int], n_docs: int, n_words: int):
        self.numbers = np.array([i for i, _, _ in items], np.int64)
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms, _ in items for t in terms}))}
        sizes = [len(terms) for _, terms, _ in items]
        starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        terms = np.fromiter((self.vocabulary[t] for _, ts, _ in items for t in ts), np.int64, int(starts[-1]))
        by_term = np.array([weights.get(t, 0) for t in sorted(self.vocabulary)], np.int64)
        times = np.fromiter((n for _, _, ns in items for n in ns), np.int64, int(starts[-1]))
        values = times * by_term[terms]
        self.weights, self.n_docs, self.n_words = by_term, n_docs, n_words
        tree = build_tree(starts, terms, values, values.astype(float), len(self.vocabulary), 1)
        # of each node only the coordinates that are not 0
        self.left, self.right = tree.left, tree.right
        self.item = tree.order[tree.begin]  # a leaf's one item
        self.coordinates = [np.flatnonzero(row) for row in tree.maxima]
        self.values = [row[at] for row, at in zip(tree.maxima, self.coordinates)]


def impacts(tf: np.ndarray, n: np.ndarray, owner: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term adds to a score per unit of weight: term counts, words of each document, document of each count."""
    m = np.array([100 - _SHARE + _SHARE * x * n_docs // n_words for x in n.tolist()], np.int64)  # no 64-bit overflow on the way
    return _GAIN * tf // (_TF * tf + _NORM * m[owner])


class Best:
    """The k best (score, id) of each item so far: scores falling, equal ones by rising id."""

    def __init__(self, count: int, k: int, floor: np.ndarray | None = None):
        self.k, self.lists = k, [[] for _ in range(count)]
        # what a document must reach to matter: a positive score, and no less than the kth known
        self.least = np.maximum(floor, 1) if floor is not None else np.ones(count, np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: list) -> None:
        kept = self.lists[item]
        for at in np.flatnonzero(scores >= self.least[item]).tolist():
            insort(kept, (-int(scores[at]), ids[at] is None, ids[at] if ids[at] is not None else 0))
            if len(kept) > self.k:
                kept.pop()
        if len(kept) == self.k:
            self.least[item] = max(self.least[item], -kept[-1][0])


class DualTreeSearch:
    """Searches trees of documents, one after the other, for the best ones of a block of items."""

    def __init__(self, block: ItemBlock, best: Best):
        self.block, self.best = block, best
        self.weakest = np.zeros(len(block.left), np.int64)
        self.bounds = self.scored = 0  # node pairs bounded and (item, document) pairs scored: the work done

    def _refresh(self) -> None:
        """The least that any document must reach for an item of each node."""
        block = self.block
        for node in range(len(block.left) - 1, -1, -1):
            self.weakest[node] = (min(self.weakest[block.left[node]], self.weakest[block.right[node]]) if block.left[node]
                                  else self.best.least[block.item[node]])

    def add(self, ids: list, starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Documents by ids, with their terms (numbers of the block's vocabulary) and impacts."""
        if not len(ids) or not len(self.block.numbers):
            return
        tree = build_tree(starts, terms, values, values * self.block.weights[terms].astype(float),
                          len(self.block.vocabulary), LEAF_DOCS)
        self._refresh()
        self._visit(0, np.zeros(1, np.int64), tree, (ids, starts, terms, values))

    def _visit(self, node: int, nodes: np.ndarray, tree: Tree, docs: tuple) -> None:
        """Item node against document nodes: what no document below can reach goes, the rest descends on both sides."""
        block = self.block
        at, values = block.coordinates[node], block.values[node]
        while True:
            bounds = (tree.maxima[np.ix_(nodes, at)] * values).sum(axis=1)
            self.bounds += len(nodes)
            keep = bounds >= self.weakest[node]
            nodes, bounds = nodes[keep], bounds[keep]
            if not len(nodes):
                return
            inner = tree.left[nodes] > 0
            below = np.concatenate((nodes[~inner], tree.left[nodes[inner]], tree.right[nodes[inner]]))
            if block.left[node]:
                for child in sorted((block.left[node], block.right[node])):
                    self._visit(child, below, tree, docs)
                self.weakest[node] = min(self.weakest[block.left[node]], self.weakest[block.right[node]])
                return
            if not inner.any():
                break
            nodes = below
        self._score(node, nodes[np.argsort(-bounds, kind="stable")], np.sort(bounds)[::-1], tree, docs)

    def _score(self, node: int, leaves: np.ndarray, bounds: np.ndarray, tree: Tree, docs: tuple) -> None:
        """Exact scores of one item in leaves, the most promising first, until no bound reaches its kth score."""
        ids, starts, terms, values = docs
        item = int(self.block.item[node])
        weight = np.zeros(len(self.block.vocabulary), np.int64)
        weight[self.block.coordinates[node]] = self.block.values[node]
        done = 0
        while done < len(leaves) and bounds[done] >= self.best.least[item]:
            some = leaves[done:done + 4]
            rows = np.concatenate([tree.order[tree.begin[x]:tree.end[x]] for x in some])
            places, owner = _entries(starts, rows)
            scores = np.zeros(len(rows), np.int64)
            filled = np.flatnonzero(starts[rows + 1] > starts[rows])
            if len(filled):
                first = np.searchsorted(owner, filled)
                scores[filled] = np.add.reduceat(weight[terms[places]] * values[places], first)
            self.best.offer(item, scores, [ids[i] for i in rows.tolist()])
            self.scored += len(rows)
            done += len(some)
        self.weakest[node] = self.best.least[item]


def _term_counts(text: str | None, known: frozenset | None) -> tuple[int, dict[bytes, int]]:
    """Words of a text, and how often each (known) term is among them; long texts are split a stretch at a time."""
    if not text:
        return 0, {}
    if len(text) <= STRETCH:
        words = words_of(text)
        return len(words), Counter(words if known is None else [w for w in words if w in known])
    total, counts, at = 0, Counter(), 0
    while at < len(text):
        end = text.find(" ", at + STRETCH)
        end = len(text) if end < 0 else end
        words = words_of(text[at:end])
        total += len(words)
        counts.update(words if known is None else [w for w in words if w in known])
        at = end
    return total, counts


def _vectors(rows: DataFrame, known) -> DataFrame:
    """`id`, `n` (words), `terms` (joined by spaces) and `tfs` (little-endian 32-bit counts) of rows (id, text)."""
    schema = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.StringType()), T.StructField("tfs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = known.value if known is not None else None
        for whole in batches:
            for batch in slices(whole):
                sizes, terms, tfs = [], [], []
                for text in batch.column(1).to_pylist():
                    n, counts = _term_counts(text, allowed)
                    sizes.append(n)
                    terms.append(b" ".join(counts).decode("utf-8"))
                    tfs.append(np.fromiter(counts.values(), "<u4", len(counts)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _document_frequencies(vectors: DataFrame) -> DataFrame:
    """term, df: counted per Arrow batch, then over all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.split_pattern(batch.column(0), " ").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1).cast(pa.int64())], ["term", "df"])

    found = vectors.filter("terms <> ''").select("terms").mapInArrow(run, "term string, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


def _add(found: DualTreeSearch, ids: list, n: np.ndarray, terms: pa.Array, tfs: list[bytes]) -> None:
    """Searches a batch of document vectors for the items of the block."""
    block, lists = found.block, pc.split_pattern(terms, " ")
    named = lists.flatten().dictionary_encode()
    numbers = np.array([block.vocabulary.get(t, -1) for t in named.dictionary.to_pylist()], np.int64)
    terms = numbers[named.indices.to_numpy(zero_copy_only=False)]
    counts = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
    known = terms >= 0
    owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))[known]
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(ids)))))
    found.add(ids, starts, terms[known], impacts(counts[known], n, owner, block.n_docs, block.n_words))


def _seed_scores(block: ItemBlock, seeds: list, k: int) -> np.ndarray:
    """The kth best score of each item among a few documents: what others must reach. 0 where fewer than k score."""
    best = Best(len(block.numbers), k)
    found = DualTreeSearch(block, best)
    for at in range(0, len(seeds), TREE_DOCS):
        rows = seeds[at:at + TREE_DOCS]
        _add(found, [None] * len(rows), np.array([r.n for r in rows], np.int64), pa.array([r.terms for r in rows], pa.large_string()),
             [bytes(r.tfs) for r in rows])
    return best.least


def _search(vectors: DataFrame, shared, k: int, floor: np.ndarray) -> DataFrame:
    """item (number), salt, id, score: the best of each task, no worse than the floor of an item."""
    id_type = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("salt", T.IntegerType()),
                           T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(len(block.numbers), k, floor)
        found = DualTreeSearch(block, best)
        for whole in batches:
            for batch in slices(whole, rows=TREE_DOCS, size=8 * TREE_TERMS):
                _add(found, batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).cast(pa.large_string()),
                     batch.column(3).to_pylist())
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(int(number), salt, None if no_id else name, -negative) for number, kept in zip(block.numbers, best.lists)
                for negative, no_id, name in kept]
        types = [pa.int64(), pa.int32(), to_arrow_type(id_type), pa.int64()]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return vectors.select("id", "n", "terms", "tfs").filter("terms <> ''").mapInArrow(run, schema)


def _top(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The k best documents of each item: the item column, rank (from 1), the id column, score.

    Terms are words with A-Z in lower case. With N documents that have a term, L terms in all of them, n in one, df
    documents with a term, tf of it in a document: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and
    a score adds w ((10^9 tf) div (1000 tf + 8 m)) over the terms of the item, repeats included, in whole numbers.
    Only scores above 0 count; equal scores rank by rising id, a NULL id last. NULL and empty texts have no
    terms: such documents are in no list and not in N, such items have no rows. Repeated rows of documents
    are documents of their own, repeated rows of items have a list each. Empty tables give an empty result.
    Only the named columns are read, so further columns cannot clash. Ids may be of any type that orders in Python as
    in Spark, such as whole numbers and strings.

    Texts are read once; what stays is a table of the items' terms in each document. Items are searched in blocks of
    about `block_words` words, each with a hierarchy over its items that the executors get, some megabytes. Tasks cut
    their documents into hierarchies of at most 4,096 and descend pairs of nodes: the largest coordinates of both sides
    bound every score below, and a pair goes when the bound is below the weakest kth score of its items. The first
    kth scores come from a search over 8,192 documents; any documents' scores are valid bounds, so this changes the
    work and not the result. Tasks give at most k rows per item, ranked per (item, salt) and then per item.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    wanted = items.select(F.monotonically_increasing_id().alias("id"), F.col(f"`{item_text_col}`").alias("text"),
                          F.col(f"`{item_col}`").alias("name"))
    wanted = stored(wanted, "search-items")
    found = stored(_vectors(wanted.select("id", "text"), None).filter("n > 0"), "search-item-terms")
    spark, name = docs.sparkSession, wanted.select("id", "name")
    item_terms = found.select(F.explode(F.split("terms", " ")).alias("term")).distinct()
    distinct = item_terms.limit(VOCABULARY + 1).collect()
    known = None
    if len(distinct) <= VOCABULARY:
        known = spark.sparkContext.broadcast(frozenset(r.term.encode() for r in distinct))
    vectors = stored(_vectors(rows, known).filter("n > 0"), "search-vectors")
    frequencies = stored(_document_frequencies(vectors), "search-df")
    totals = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()

    words = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-words // block_words))
    found = found.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
    # a limit that is collected reads a few files, one inside a plan takes rows from all tasks
    seeds = vectors.select("n", "terms", "tfs").filter("terms <> ''").limit(SEED_DOCS).collect()
    parts = []
    for number in range(count if totals.docs else 0):
        mine = found.filter(F.col("block") == number)
        listed = [(r.id, r.terms.split(" "), np.frombuffer(bytes(r.tfs), "<u4").tolist())
                  for r in mine.select("id", "terms", "tfs").collect()]
        if not listed:
            continue
        terms = mine.select(F.explode(F.split("terms", " ")).alias("term")).distinct()
        weights = {r.term: math.floor(_SCALE * math.log((2 * totals.docs + 2) / (2 * r.df + 1)))
                   for r in frequencies.join(terms, "term").collect()}
        block = ItemBlock(listed, weights, totals.docs, totals.words)
        shared, floor = spark.sparkContext.broadcast(block), _seed_scores(block, seeds, k)
        parts.append(stored(_top(_search(vectors, shared, k, floor), k, "item", "salt").drop("rank"), "search-found"))
    if not parts:
        return spark.createDataFrame([], T.StructType([
            T.StructField(item_col, wanted.schema["name"].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, rows.schema["id"].dataType), T.StructField("score", T.LongType())]))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _top(every, k, "item").join(name.withColumnRenamed("id", "item"), "item").select(
        F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
