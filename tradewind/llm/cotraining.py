"""Document quality by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import add_columns, release_memory, slices, stored, without
from tradewind.llm.hashing import KEPT_POWERS

TARGETS = ("quality", "toxic")
TEXT_BUCKETS, PAGE_BUCKETS = 1 << 18, 1 << 12
BUCKETS = TEXT_BUCKETS + PAGE_BUCKETS  # text view first
LABELLED_ROWS = 20_000  # bound of the labelled sample, which goes to every executor
ROUNDS = 2
CONFIDENT = 0.97
FOLDS = 3  # parts of the labelled rows; each is judged by counts that leave it out
HALF_WEIGHT = 3_000  # a feature of a document of n features weighs HALF_WEIGHT / (HALF_WEIGHT + n) when fitting
MIN_Z, MAX_WEIGHT = 3.0, 4.0
RIDGE = 0.01  # penalty on scaled coefficients: only so that classes which separate have a finite minimum
CHUNK = 1 << 12
SLICE_BYTES = 1 << 18  # of text at once; its features take some 60 times as much

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; those of ordinary slices are kept by the worker process."""
    tables = _powers
    if len(tables[0]) < size:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        if size <= KEPT_POWERS:
            _powers[:] = tables
    return tables[0][:size], tables[1][:size]


def _bucket(values: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt * 0x94D049BB133111EB & _MASK)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(40)).astype(np.int64) % buckets


def _step(values: np.ndarray) -> np.ndarray:
    """Values of 0 and more on a logarithmic scale of 4 steps per doubling."""
    return np.floor(4 * np.log2(1 + np.maximum(values, 0))).astype(np.uint64)


def features(texts: list[str | None], pages: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all documents' features, the documents they belong to, for the text view and the page view.

    Text view: each word and its beginnings of 4 to 7 bytes (a word that repeats the one before only counts as a
    repetition), what stands between two words, words in capitals. Page view: each of `pages` (language, source
    and the like) as a category, and steps of length, words, lines, word length and the shares of capitals,
    digits, symbols, repetitions and distinct words.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    lengths = np.array([len(r) + 1 for r in raw])
    first = np.cumsum(lengths) - lengths
    power, inverse = _power_tables(len(data))
    low = _LOWER[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    word = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    owner = np.searchsorted(first, starts, "right") - 1

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * inverse[start]

    whole = hashed(starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    capital = np.zeros(len(data) + 1, np.int64)
    np.cumsum(low != data, out=capital[1:])
    shouted = (capital[ends] - capital[starts] == size) & (size > 1)
    found = [(_bucket(whole[~again], 1, TEXT_BUCKETS), owner[~again])]
    for length in (4, 5, 6, 7):
        longer = np.flatnonzero((size > length) & ~again)
        found.append((_bucket(hashed(starts[longer], starts[longer] + length), length, TEXT_BUCKETS), owner[longer]))
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    found.append((_bucket(hashed(ends[pair], starts[pair + 1]), 2, TEXT_BUCKETS), owner[pair]))
    for salt, rows in ((8, again), (9, shouted)):
        found.append((_bucket(np.full(int(rows.sum()), salt, np.uint64), salt, TEXT_BUCKETS), owner[rows]))
    text_bucket, text_owner = (np.concatenate(column) for column in zip(*found))

    count = len(texts)
    of = lambda rows: np.bincount(rows, minlength=count).astype(float)
    place = lambda mask: np.add.reduceat(mask.astype(np.int64), first).astype(float)
    chars, words = np.maximum(lengths - 1, 1), of(owner)
    shares = [place(low != data) / chars, place((data > 47) & (data < 58)) / chars, place(~word) / chars, of(owner[again]) / np.maximum(words, 1),
              place(data == 124) / chars, of(owner[shouted]) / np.maximum(words, 1)]
    columns = [_step(lengths - 1) // 2, _step(words) // 2, _step(place(data == 10)), _step((chars - place(~word)) / np.maximum(words, 1)),
               *[_step(share * 100) for share in shares]]
    for i in range(len(pages[0]) if pages else 0):
        columns.append(np.array([zlib.crc32(repr(p[i]).encode("utf-8", "surrogatepass")) for p in pages], np.uint64))
    page_bucket = np.concatenate([_bucket(c, 20 + i, PAGE_BUCKETS) for i, c in enumerate(columns)]) + TEXT_BUCKETS
    return text_bucket, text_owner, page_bucket, np.tile(np.arange(count), len(columns))


def _weigh(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each bucket; buckets without clear evidence share one weight."""
    total_yes, total_no = max(yes.sum(), 1.0), max(no.sum(), 1.0)
    ratio = total_yes / total_no
    z = (yes - no * ratio) / np.sqrt(yes + no * ratio * max(ratio, 1) + 1)
    clear = np.abs(z) >= MIN_Z
    rate_yes, rate_no = (yes + 0.5) / total_yes, (no + 0.5) / total_no
    rest = np.log((1 - min(yes[clear].sum() / total_yes, 0.99)) / (1 - min(no[clear].sum() / total_no, 0.99)))
    return np.where(clear, np.clip(np.log(rate_yes / rate_no), -MAX_WEIGHT, MAX_WEIGHT), rest)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients with the constant last.

    Newton steps on scaled columns. A step is halved until the penalised loss falls, since a full one overshoots
    where the classes nearly separate; the penalty keeps the minimum finite there.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge, sign = np.append(np.full(x.shape[1], RIDGE), 1e-3), 2 * y - 1
    loss = lambda b: np.logaddexp(0, -sign * (z @ b)).sum() + 0.5 * (ridge * b * b).sum()
    beta = np.zeros(z.shape[1])
    now = loss(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        gradient = z.T @ (p - y) + ridge * beta
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), gradient)
        size, slope = 1.0, float(gradient @ step)
        while size > 1e-10 and loss(beta - size * step) > now - 1e-4 * size * slope:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now < 1e-9 * max(1.0, now):
            break
    beta[:-1] /= scale
    beta[-1] -= mean @ beta[:-1]
    return beta


@dataclass
class Model:
    """Weights of both views and how their scores become probabilities; None for a target that cannot be learnt."""

    weights: dict[str, np.ndarray]  # by target
    views: dict[str, list[np.ndarray]]  # by target: the calibration of the text view and of the page view
    both: dict[str, np.ndarray]  # by target: the calibration of the two together
    trust: dict[str, list[tuple[float, float]]]  # by target and view: what its sure 0 and sure 1 weigh as a label for the other
    loss: dict[str, float]  # by target: of both, over all labels, each judged by counts without its fold


def _scores(weights: np.ndarray, feats: tuple, count: int) -> np.ndarray:
    """Two columns a view: the sum of weights by the root of the number of features, and their mean."""
    columns = []
    for bucket, owner in (feats[:2], feats[2:]):
        n = np.bincount(owner, minlength=count)
        total = np.bincount(owner, weights[bucket], minlength=count)
        columns += [total / np.sqrt(n + 1), total / (n + 1)]
    return np.column_stack(columns) if count else np.zeros((0, 4))


def _probability(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))


def _probabilities(model: Model, feats: tuple, count: int, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the text view, the page view, and both."""
    if target not in model.both:
        nothing = np.full(count, 0.5)
        return nothing, nothing, nothing
    x = _scores(model.weights[target], feats, count)
    text, page = model.views[target]
    return _probability(text, x[:, :2]), _probability(page, x[:, 2:]), _probability(model.both[target], x)


def _fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def _batches(batches: Iterator[pa.RecordBatch], page_cols: int):
    """Slices as (ids, feature buckets, number of rows)."""
    for whole in batches:
        for batch in slices(whole, size=SLICE_BYTES):
            pages = list(zip(*[batch.column(2 + i).to_pylist() for i in range(page_cols)])) if page_cols else [()] * batch.num_rows
            yield batch.column(0).to_pylist(), features(batch.column(1).to_pylist(), pages), batch.num_rows
    release_memory()


def _gather(rows: DataFrame, labels: dict, page_cols: int, model: Model | None) -> np.ndarray:
    """Sums of features by target and class: by fold over labelled documents or, with a model, over those it labels itself.

    With a model the text view's sums take the documents without a label that the page view is sure of, weighed by how
    far its sureness is trusted, and the other way round. Each task sends its sums in fixed chunks; equal
    chunks are added up by a grouping, so the driver gets sums of fixed size.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((labels, model))
    shape = (FOLDS if model is None else 1, len(TARGETS), 2, BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, current = shared.value
        sums = np.zeros(shape, np.float64)
        for ids, feats, n in _batches(batches, page_cols):
            given = [known.get(i) for i in ids]
            fold = np.array([0 if current is not None or g is None else _fold(i) for i, g in zip(ids, given)])
            views = (feats[:2], feats[2:])
            weight_of = [(HALF_WEIGHT / (HALF_WEIGHT + np.bincount(owner, minlength=n)))[owner] for _, owner in views]
            for t, target in enumerate(TARGETS):
                if current is None:
                    label = np.array([-1 if g is None or g[t] is None else g[t] for g in given])
                    by_view, trust = [label, label], [(1.0, 1.0)] * 2
                elif target in current.both:
                    text, page, _ = _probabilities(current, feats, n, target)
                    unknown = np.array([g is None for g in given], bool)
                    by_view = [np.where(unknown & (p >= CONFIDENT), 1, np.where(unknown & (p <= 1 - CONFIDENT), 0, -1)) for p in (page, text)]
                    trust = current.trust[target][::-1]
                else:
                    continue
                for view, (bucket, owner) in enumerate(views):
                    for value in (0, 1):
                        for part in range(shape[0]):
                            mine = ((by_view[view] == value) & (fold == part))[owner]
                            if trust[view][value] > 0 and mine.any():
                                sums[part, t, value] += trust[view][value] * np.bincount(bucket[mine], weight_of[view][mine], minlength=BUCKETS)
        flat = sums.reshape(-1)
        used = [i for i in range(0, len(flat), CHUNK) if flat[i:i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([flat[i:i + CHUNK].tobytes() for i in used], pa.binary())], ["at", "sums"])
        del sums, flat
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(sums)
                total[at] = total[at] + values if at in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["at", "sums"])

    parts = rows.mapInArrow(count, "at bigint, sums binary").repartition(32, "at").mapInArrow(add, "at bigint, sums binary")
    flat = np.zeros(int(np.prod(shape)))
    for row in parts.collect():
        flat[row.at:row.at + CHUNK] += np.frombuffer(row.sums)
    return flat.reshape(shape)


def _labelled(labels: DataFrame, id_col: str, limit: int) -> dict[int, tuple]:
    """At most `limit` labelled rows, by a hash of their id: id -> (quality, toxic)."""
    rows = (labels.filter(F.col(f"`{id_col}`").isNotNull())
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(t).cast("int").alias(t) for t in TARGETS])
            .groupBy("id").agg(*[F.max(t).alias(t) for t in TARGETS]).orderBy(F.xxhash64("id"), "id").limit(limit).collect())
    return {r.id: tuple(r[t] if r[t] in (0, 1) else None for t in TARGETS) for r in rows}


def _weights(sums: np.ndarray) -> np.ndarray:
    """Weights of both views by target, from sums by target, class and bucket."""
    return np.array([np.concatenate([_weigh(of[1, view], of[0, view]) for view in (slice(0, TEXT_BUCKETS), slice(TEXT_BUCKETS, BUCKETS))])
                     for of in sums], np.float32)


def _calibrated(labelled: np.ndarray, taught: np.ndarray, sample: DataFrame, known: dict, page_cols: int) -> Model:
    """A model of the sums of labelled documents by fold and of those that the views taught each other.

    Each fold has weights from the other folds and what was taught; the model's are their mean. Probabilities, trust and
    loss are fitted on all labelled documents, each scored by the weights of its own fold, which have not seen its label.
    """
    by_fold = np.array([_weights(labelled.sum(axis=0) - labelled[fold] + taught[0]) for fold in range(FOLDS)])
    shared = sample.sparkSession.sparkContext.broadcast(by_fold)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, feats, n in _batches(batches, page_cols):
            fold = np.array([_fold(i) for i in ids])
            x = np.zeros((n, 4 * len(TARGETS)))
            for part in range(FOLDS):
                if (fold == part).any():
                    x[fold == part] = np.column_stack([_scores(of, feats, n) for of in shared.value[part]])[fold == part]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    scored = sample.mapInArrow(score, "id bigint, x array<double>").collect()
    scored.sort(key=lambda r: (r.id, r.x))
    model = Model(dict(zip(TARGETS, by_fold.mean(axis=0))), {}, {}, {}, {})
    for t, target in enumerate(TARGETS):
        rows = [(r.x[4 * t:4 * t + 4], known[r.id][t]) for r in scored if known[r.id][t] is not None]
        x, y = np.array([r[0] for r in rows]).reshape(-1, 4), np.array([r[1] for r in rows], float)
        if 0 < y.sum() < len(y):
            model.views[target] = [_fit_logistic(x[:, :2], y), _fit_logistic(x[:, 2:], y)]
            model.both[target] = _fit_logistic(x, y)
            model.trust[target] = [_trust(_probability(b, x[:, c]), y) for b, c in zip(model.views[target], (slice(0, 2), slice(2, 4)))]
            p = np.clip(_probability(model.both[target], x), 1e-9, 1 - 1e-9)
            model.loss[target] = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return model


def _trust(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """By how much a view that is sure of a class is more often right than wrong, by the labels; few labels give little."""
    out = []
    for value, mine in ((0, p <= 1 - CONFIDENT), (1, p >= CONFIDENT)):
        right = int((y[mine] == value).sum())
        out.append(max(0.0, (2 * right - int(mine.sum())) / (int(mine.sum()) + 2)))
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        page_cols: tuple[str, ...] = ("lang", "source"), rounds: int = ROUNDS, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Co-training over all documents.

    Both views start from the labelled sample. In each round a document without a label that one view is sure of
    (CONFIDENT by its calibrated probability) counts for the other view with that label; no other document does. It weighs
    as much as the view's sureness of this class is trusted: by how much more often it is right than wrong about labels
    that its counts have not seen (cross-validation in FOLDS parts). With few labels a class teaches little, with none
    nothing; no number of labels switches it on. A target whose loss on such labels a round does not lower keeps what it
    had. Each round is one pass over the documents, and
    what it brings to the driver has a fixed size.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       *[F.col(f"`{c}`").cast("string").alias(f"p{i}") for i, c in enumerate(page_cols)])
    known = _labelled(labels, id_col, labelled_rows)
    if not known:
        return Model({}, {}, {}, {}, {})
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in known], "id bigint")
    sample = stored(rows.join(F.broadcast(ids), "id"), "quality-sample")
    pages = len(page_cols)
    labelled = _gather(sample, known, pages, None)
    model = _calibrated(labelled, np.zeros_like(labelled[:1]), sample, known, pages)
    for _ in range(rounds):
        taught = _calibrated(labelled, _gather(rows, known, pages, model), sample, known, pages)
        for target in model.both:
            if taught.loss.get(target, np.inf) > model.loss[target]:  # what this round taught does not help
                for part in ("weights", "views", "both", "trust", "loss"):
                    getattr(taught, part)[target] = getattr(model, part)[target]
        model = taught
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  page_cols: tuple[str, ...] = ("lang", "source"), min_quality: float = 0.5, max_toxic: float = 0.5,
                  model: Model | None = None) -> DataFrame:
    """The input with `p_quality`, `p_toxic` and `kept`.

    `labels` has the id, `quality` and `toxic` (0 or 1; other values and NULL are unknown). A target with no
    labelled row of either class has 0.5 everywhere and rejects nothing. NULL text counts as the empty text, NULL
    metadata as a category of its own. Rows that repeat an id share its label; an id with several labels takes the
    larger. Very long texts are read whole; the longer, the less a feature of theirs weighs when fitting. Input columns named like a
    result are replaced.
    """
    fields = [T.StructField("p_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())]
    docs = without(docs, ["p_quality", "p_toxic", "kept"])
    model = model or fit(docs, labels, id_col, text_col, page_cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        pages = [tuple(None if v is None else str(v) for v in row) for row in zip(*map(column, page_cols))] or [()] * batch.num_rows
        feats = features(column(text_col), pages)
        return [pa.array(_probabilities(shared.value, feats, batch.num_rows, t)[2], pa.float64()) for t in TARGETS]

    scored = add_columns(docs, fields, step, SLICE_BYTES)
    rejects = lambda target: F.lit(target in model.both)
    bad = (rejects("quality") & (F.col("p_quality") < min_quality)) | (rejects("toxic") & (F.col("p_toxic") > max_toxic))
    return scored.withColumn("kept", ~bad)
