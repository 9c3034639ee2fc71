"""Encoding, wavelet-matrix shards and packing: equal to the library, round trips, gapless sequences."""

import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tradewind.llm import best_fit, packing, wavelet
from tradewind.llm.tokens import Encoder, encoder, tokenizer_path

KINDS = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
BITS = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", " ", "\x1c", "a", "The", "'s", "'ll", "42", "!?", "é", "ß", "日本", "́",
        "Σ", "ΑΣ", "<|endoftext|>", "_", ".", "İ", "​", "ﬁ", "½", "²", "word,", "ª", "|", "don't", "'"]


@pytest.mark.parametrize("name, drops_space", KINDS)
def test_same_ids_as_the_library(name, drops_space):
    dice = random.Random(5)
    texts = [None, "", *["".join(dice.choice(BITS) for _ in range(dice.randint(0, 12))) for _ in range(6_000)]]
    tool = encoder(tokenizer_path(name), drops_space)
    for start in range(0, len(texts), 700):
        part = texts[start:start + 700]
        want = tool.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [ids.tolist() for ids in tool.encode(pa.array(part, pa.string()))] == [e.ids for e in want]


@pytest.mark.parametrize("name, drops_space", KINDS)
def test_known_words_take_no_calls_of_their_own(name, drops_space):
    stems = ["".join(pair) for pair in zip("abcdefghij" * 10, "klmnopqrst" * 10, "éuvwxyzABC" * 10)]
    stems = [f"{stem}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i, stem in enumerate(stems)]
    text = " ".join(f"{lead}{stem}{tail}" for stem in stems for tail in ("", ",", ".", "!?", "),") for lead in ("", "\n"))
    tool, calls = Encoder(tokenizer_path(name), drops_space), Counter()
    tool.encode(pa.array([text]))
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        ids = tool.encode(pa.array([text]))[0].tolist()
    finally:
        sys.setprofile(None)
    assert ids == tool.tokenizer.encode(text, add_special_tokens=False).ids
    assert calls["call"] + calls["c_call"] < 400  # the text has 1,000 words


def test_wavelet_queries():
    dice = random.Random(1)
    for size in (0, 1, 7, 70_000, 140_000):
        for top in (2, 5, 50_257):
            ids = np.random.default_rng(size + top).integers(0, top, size).astype("<u2")
            file = wavelet.WaveletFile(wavelet.write_shard(ids, [size], (top - 1).bit_length()))
            assert len(file) == size and (file.all_ids() == ids).all() and file.count(top + 70_000) == 0
            for _ in range(20 if size else 0):
                at = dice.randrange(size)
                value, places = int(ids[at]), np.flatnonzero(ids == ids[at])
                number = dice.randrange(len(places))
                assert file.access(at) == value
                assert file.rank(value, at) == int((ids[:at] == value).sum())
                assert file.select(value, number) == places[number]
    assert file.occurrences(value)[:3] == places[:3].tolist()
    with pytest.raises(IndexError):
        file.access(size)
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"something else")


ROWS = [(7, "alpha beta  gamma"), (3, None), (3, ""), (None, "no id"), (1, "x " * 9_000), (2, "tie"), (2, "tie"), (9, "ende\n\n\n")]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, start string, LENGTH int").repartition(3)


def encoded(rows, name, end):
    tool = Tokenizer.from_file(tokenizer_path(name))
    return [(i, np.array([*tool.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


@pytest.mark.parametrize("shard_tokens", [4, 1 << 20])
def test_token_shards(spark, tmp_path, shard_tokens):
    rows = [*ROWS, *[(100 + i, f"text {i} " * (i % 5)) for i in range(60)]]
    path = str(tmp_path / "shards")
    got = wavelet.token_shards(documents(spark, rows), tokenizer_path("byte_bpe_50k.json"), False, 2, path, shard_tokens=shard_tokens).collect()
    want = encoded(rows, "byte_bpe_50k.json", 2)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    shards = spark.read.parquet(path).collect()
    assert len({*(p for p in (tmp_path / "shards").glob("*.parquet"))}) >= len(shards)
    assert sum(len(wavelet.WaveletFile(bytes(s.data))) for s in shards) == at
    empty = wavelet.token_shards(documents(spark, []), tokenizer_path("byte_bpe_50k.json"), False, 2)
    assert empty.count() == 0


def test_shortest_pack_first():
    dice = random.Random(6)
    for _ in range(50):
        size = dice.choice([8, 64, 512])
        histogram = Counter(dice.randint(1, size) for _ in range(dice.randint(0, 400)))
        patterns = packing.shortest_pack_first(dict(histogram), size)
        used = Counter()
        for count, lengths in patterns:
            assert count > 0 and sum(lengths) <= size
            used.update({n: count * times for n, times in Counter(lengths).items()})
        assert used == histogram
    # each goes to the pack with most room: 6 and 5 open packs, 3 joins the 5, 2 the 6
    assert sorted(tuple(p) for _, p in packing.shortest_pack_first({6: 1, 5: 1, 3: 1, 2: 1}, 10)) == [(5, 3), (6, 2)]


@pytest.mark.parametrize("unit", [0, 16])
def test_packing(spark, unit, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    dice = random.Random(3)
    rows = [*ROWS, *[(100 + i, "word " * dice.choice([3, 3, 3, dice.randint(0, 300)])) for i in range(150)]]
    docs = documents(spark, rows)
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), True, 1, size=128, unit=unit).collect()
    want = dict(encoded(rows, "word_bpe_49k.json", 1))
    sequences = defaultdict(list)
    for r in got:
        ids = want[r.doc_id]
        if r.doc_id not in (2, 3):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in encoded(rows, "word_bpe_49k.json", 1))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in got) > 0.95 * 128 * len(sequences)
    assert packing.pack(documents(spark, []), tokenizer_path("word_bpe_49k.json"), True, 1).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"some text {i} " * (i % 9)) for i in range(40)]
    docs, name = spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")
    pieces = packing.stored(packing.pack(docs, name, True, 1, size=32), "test-pieces")
    filled = {r.sequence_id: r.ids for r in packing.sequences(docs, pieces, name, True, 1).collect()}
    want = dict(encoded(rows, "word_bpe_49k.json", 1))
    for r in pieces.collect():
        assert filled[r.sequence_id][r.offset:r.offset + r.length] == want[r.doc_id][r.start:r.start + r.length].tolist()


@pytest.mark.parametrize("name, drops_space", KINDS)
def test_special_tokens_in_a_text(name, drops_space):
    dice = random.Random(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "The", "word,", "é"]
    texts = [None, "<|endoftext|>", "a <|endoftext|> b", *["".join(dice.choice(bits) for _ in range(dice.randint(0, 9))) for _ in range(800)]]
    library = Tokenizer.from_file(tokenizer_path(name))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder(tokenizer_path(name), drops_space).encode(pa.array(texts, pa.string()))] == want
    assert library.token_to_id("<|endoftext|>") in want[2]


@pytest.mark.parametrize("operator", ["token_shards", "best_fit", "sequences"])
def test_idle_workers_hold_no_caches(spark, operator):
    def cached(batches):
        from tradewind.llm import tokens

        list(batches)
        kept = sum(len(kind) for tool in tokens._encoders.values() for kind in (tool.stems, tool.tails, tool.others))
        yield pa.RecordBatch.from_arrays([pa.array([kept], pa.int64())], ["kept"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, f"text {chr(97 + i % 26) * 3}, (word!) {i}") for i in range(200)], "doc_id long, text string").repartition(8)
    name = tokenizer_path("word_bpe_49k.json")
    if operator == "token_shards":
        assert wavelet.token_shards(docs, tokenizer_path("byte_bpe_50k.json"), False, 2).count() == 200
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    elif operator == "best_fit":
        assert best_fit.pack_best_fit(docs, name, True, 0).count() == 200
    else:
        pieces = packing.stored(packing.pack(docs, name, True, 1), "test-pieces")
        assert packing.sequences(docs, pieces, name, True, 1).count() > 0
    kept = spark.range(0, 64, 1, 16).mapInArrow(cached, "kept long").collect()
    assert len(kept) == 16 and sum(r.kept for r in kept) == 0
