"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import WORD, add_columns, stored, texts, without, words_of

BLOCK_WORDS = 100_000  # words of one automaton; larger benchmarks are matched block after block
PIECE_WORDS = 5_000  # longer items are cut into pieces that overlap by a window less one word


class SuffixAutomaton:
    """All substrings of the given word lists, with the items that own each window.

    States are numbered; `step[s]` maps a word to the next state, `link[s]` is the suffix link and `length[s]`
    the longest string of a state. `window[s]` is the length of the window that state s stands for (0: none),
    `owners[s]` the ids of the items with that window, `outer[s]` the nearest state on the chain of suffix
    links, s itself left out, that stands for a window. A state has at most one window length: a whole short
    item is the longest string of its state, and shorter than a full window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.window = [0] * len(self.step)
        self.owners: dict[int, set[str]] = {}
        for item, words in items:
            size = min(window, len(words))
            state = 0
            for i, word in enumerate(words):
                state = self.step[state][word]
                while self.length[self.link[state]] >= size and self.link[state] > 0:
                    state = self.link[state]
                if i + 1 >= size:
                    self.window[state] = size
                    self.owners.setdefault(state, set()).add(item)
        self.outer = [0] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            up = self.link[state]
            self.outer[state] = up if self.window[up] else self.outer[up]

    def _state(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.step[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: bytes, target: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Merged hit spans [start, end) in words, the ids of the items found, the longest match."""
        step, link, length, window, outer = self.step, self.link, self.length, self.window, self.outer
        spans: list[list[int]] = []
        found: set[str] = set()
        state = matched = longest = 0
        for i, word in enumerate(words):
            following = step[state].get(word)
            while following is None:
                if not state:
                    matched = -1
                    following = 0
                else:
                    state = link[state]
                    matched = length[state]
                    following = step[state].get(word)
            state, matched = following, matched + 1
            if matched > longest:
                longest = matched
            size = window[state]
            at = state if 0 < size <= matched else outer[state]
            if at:
                start = i + 1 - window[at]
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
                while at:
                    found |= self.owners[at]
                    at = outer[at]
        return spans, found, longest


_built: dict[tuple, SuffixAutomaton] = {}


def _automaton(block: Broadcast, window: int) -> SuffixAutomaton:
    """Built once in each worker process for the block in use."""
    key = (block.value[0], window)
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(block.value[1], window)
    return _built[key]


def _item_pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Item id and at most PIECE_WORDS of its words; every window of an item lies within one piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(texts(batch, "id"), texts(batch, "text")):
                words = words_of(text)
                for start in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS - window + 1):
                    ids.append(item)
                    pieces.append(words[start:start + PIECE_WORDS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(pieces, pa.list_(pa.binary()))], ["id", "words"])

    chosen = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                          F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(cut, "id string, words array<binary>").distinct()


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut_out(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
_SPANS_ARROW = pa.list_(pa.list_(pa.int32()))


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = 10, max_span: int | None = None) -> DataFrame:
    """The documents with `n_words`, `n_hit`, `longest_match`, `item_ids`, `hit_spans`.

    Words are `words_of`. An item's windows are its runs of `window` words, or the whole item if it has fewer
    but not none. A document word in any occurrence of a window is hit; `hit_spans` are the merged word spans
    [start, end), `item_ids` the sorted ids of all items with a window in the text, `longest_match` the longest
    run that any item has too. NULL and empty texts have no words and no hits; NULL items match nothing and an
    item without an id counts as id ''. Items with one id count as one. An empty benchmark hits nothing.
    Documents are only mapped, never shuffled or joined; input columns named like a result are replaced. With
    `max_span` there is also `clean_text`, without the spans of more hit words.

    The benchmark is a stated query set. It goes to the executors in blocks of about BLOCK_WORDS words
    (checked before: the number of blocks follows from a count), each turned into an automaton there; with
    more than one block, the documents pass through one block after the other and stay in the shared folder
    between them.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
              T.StructField("longest_match", T.IntegerType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
              T.StructField("hit_spans", _SPANS)]
    if max_span is not None:
        fields.append(T.StructField("clean_text", T.StringType()))
    docs = without(docs, [f.name for f in fields])
    pieces = stored(_item_pieces(items, item_id, item_text, window), "benchmark-pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(blocks)))
    for number in range(blocks):
        rows = placed.filter(F.col("block") == number).select("id", "words").collect()
        items_here = [(r.id, [bytes(w) for w in r.words]) for r in rows]
        block = docs.sparkSession.sparkContext.broadcast((str(uuid.uuid4()), items_here))
        last = number + 1 == blocks
        docs = _scan_block(docs, block, text_col, window, fields if last else fields[:5], number == 0, max_span if last else None)
        if number + 1 < blocks:
            docs = stored(docs, "decontaminate-round")
    return docs


def _scan_block(docs: DataFrame, block: Broadcast, text_col: str, window: int, fields: list, first: bool, max_span: int | None) -> DataFrame:
    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        automaton = _automaton(block, window)
        n_words, n_hit, most, ids, spans, clean = [], [], [], [], [], []
        empty = [None] * batch.num_rows
        before = [empty] * 3 if first else [texts(batch, n) for n in ("_most", "_ids", "_spans")]
        for text, most0, ids0, spans0 in zip(texts(batch, text_col), *before):
            words = words_of(text)
            here, found, longest = automaton.scan(words)
            if not first:
                here, found, longest = _merge([*here, *spans0]), found | {*ids0}, max(longest, most0)
            n_words.append(len(words))
            n_hit.append(sum(e - s for s, e in here))
            most.append(longest)
            ids.append(sorted(found))
            spans.append(here)
            if max_span is not None:
                over = [s for s in here if s[1] - s[0] > max_span]
                clean.append(_cut_out(text, over) if over else text)
        out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(most, pa.int32()),
               pa.array(ids, pa.list_(pa.string())), pa.array(spans, _SPANS_ARROW)]
        return out if max_span is None else [*out, pa.array(clean, pa.string())]

    if not first:
        docs = docs.withColumnsRenamed({"longest_match": "_most", "item_ids": "_ids", "hit_spans": "_spans"})
    return add_columns(docs, fields, step).drop("_most", "_ids", "_spans")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """`find_hits` with `clean_text` and `dropped`.

    Spans of more than `max_span` hit words are cut out of `clean_text`, first to last character. A document
    whose hit words are more than `max_coverage` of its words is `dropped`: what is left of it makes no text.
    Texts without such spans stay as they are, NULL included.
    """
    found = find_hits(docs, items, text_col, item_id, item_text, window, max_span)
    return found.withColumn("dropped", F.coalesce(F.col("n_hit") > F.col("n_words") * max_coverage, F.lit(False)))
