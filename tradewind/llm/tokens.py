"""Token ids of whole texts with the tokenizers library: every distinct chunk of a batch is encoded once."""

from __future__ import annotations

import os
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_OTHER = -1  # in place of a piece's number: a stem that is not one piece of letters
CACHE_ENTRIES = 300_000  # of each cache of a worker process, some 60 MB; a cache starts anew when it is full
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A run of three white-space characters, or of two at the end, may be one piece that a cut would divide.
_LONG_GAP = f"{_SPACE}{{3}}|{_SPACE}{{2}}$"


_EMPTY, _LINE_FEED = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1 ... of runs of those sizes, one run after the other."""
    ends = np.cumsum(sizes, dtype=starts.dtype)
    places = np.repeat(starts - (ends - sizes), sizes)
    places += np.arange(len(places), dtype=starts.dtype)
    return places


def _ends(texts: pa.Array, trimmed: pa.Array) -> pa.Array:
    """What trimming has taken off the ends of texts."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    left = pc.binary_length(trimmed).to_numpy().astype(np.int64)
    sizes = np.diff(bounds) - left
    taken = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[_places(bounds[:-1] + left, sizes)]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(taken))


class Encoder:
    """The ids that `encode(text, add_special_tokens=False)` gives for a whole text.

    A text is cut before every space and line feed, and each distinct chunk of a batch is encoded once. That is
    exact where the tokenizer's own pre-tokenizer never joins characters across such a place. For byte-level BPE
    with the usual pattern it does so only within longer gaps; texts with such a gap are encoded whole. Where
    white space is dropped altogether (`drops_space`), chunks are what stands between spaces and line feeds.
    Texts that hold the string of a special or other added token get its id, as the library gives it; they are encoded whole.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        # each cache has the numbers of its pieces in the pool
        self.stems: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.forget()
        # how the byte-level pre-tokenizer shows each byte: asked of it, character by character
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {byte: shown for char in map(chr, range(256))
                      for byte, shown in zip(char.encode(), split(char)[0][0])}
        self.space = self.shown.pop(32)
        self.line_feed = self._whole("\n")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, cache: dict[str, int], names: list[str], found: Iterable[list[int]]) -> None:
        """Gives the ids that names stand for the next numbers in the pool."""
        cache.update(zip(names, range(len(self.sizes), len(self.sizes) + len(names))))
        flat, sizes = [], []
        for ids in found:
            flat += ids
            sizes.append(len(ids))
        self.pool = np.concatenate((self.pool, np.array(flat, self.dtype)))
        self.sizes = np.concatenate((self.sizes, np.array(sizes, np.int64)))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _pieces(self, texts: list[str], lead: str = "") -> Iterator[list[int]]:
        """Ids of texts without space that are one piece of the pre-tokenizer after `lead`: straight through the library's model."""
        tokenize, joined = self.model.tokenize, " ".join(texts)
        if not joined.isascii():
            texts = joined.encode().decode("latin-1").translate(self.shown).split(" ")
        return ([t.id for t in tokenize(lead + text)] for text in texts)

    def _learn_stems(self, names: list[str]) -> None:
        """Chunks without the punctuation at their ends: Latin letters, maybe after a line feed, or of another kind."""
        plain, latin, after = [], [], []
        for name in names:
            if name.isalpha() and (name.isascii() or max(name) < "\u0100"):
                (plain if name.isascii() else latin).append(name)
            elif name[:1] == "\n" and (bare := name[1:]).isalpha() and (bare.isascii() or max(bare) < "\u0100"):
                after.append(name)
            else:
                self.stems[name] = _OTHER
        for some in (plain, latin):
            if self.drops_space:
                self._keep(self.stems, some, self._pieces([name.lower() for name in some]))
            else:
                self._keep(self.stems, some, self._pieces(some, self.space))
        self._keep(self.stems, after, (self.line_feed + ids for ids in self._pieces([name[1:] for name in after])))

    def _learn_tails(self, names: list[str]) -> None:
        self._keep(self.tails, names, self._pieces(names))

    def _learn_others(self, names: list[str]) -> None:
        """Chunks of any kind. A line feed is a piece of its own; any other chunk follows a space."""
        if self.drops_space:
            found = map(self._whole, names)
        else:
            found = (self.line_feed + self._whole(name[1:]) if name[:1] == "\n" else self._whole(f" {name}") for name in names)
        self._keep(self.others, names, found)

    def _numbers(self, cache: dict[str, int], names: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        """The pool's numbers of named pieces, new ones after `learn`."""
        coded = names.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(cache.get, distinct))
        if None in numbers:
            learn([name for name, number in zip(distinct, numbers) if number is None])
            numbers = list(map(cache.get, distinct))
        return np.array(numbers, np.int64)[coded.indices.to_numpy()]

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one chunk after the other, and how many each has: those of the stem and of the
        punctuation after it, or of a chunk of another kind."""
        trimmed = pc.utf8_rtrim(chunks, characters=string.punctuation)
        stems = self._numbers(self.stems, trimmed, self._learn_stems)
        tails = self._numbers(self.tails, _ends(chunks, trimmed), self._learn_tails)
        odd = np.flatnonzero(stems == _OTHER)
        stems[odd], tails[odd] = self._numbers(self.others, chunks.take(pa.array(odd)), self._learn_others), 0
        parts = np.column_stack((stems, tails)).ravel()
        sizes = self.sizes[parts]
        return self.pool[_places(self.starts[parts], sizes)], sizes.reshape(-1, 2).sum(axis=1, dtype=np.int32)

    def forget(self) -> None:
        """Empties the caches: an idle worker process would otherwise keep them."""
        for kept in (self.stems, self.tails, self.others):
            kept.clear()
        # the ids of all known pieces; number 0 is the empty piece
        self.pool, self.sizes, self.starts = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; NULL counts as the empty text."""
        if len(self.sizes) > CACHE_ENTRIES:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole: dict[int, np.ndarray] = {}
        odd = np.zeros(len(texts), bool)
        for content in self.added:
            odd |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        if not self.drops_space:
            odd |= pc.match_substring_regex(texts, _LONG_GAP).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            whole[int(i)] = np.array(self._whole(texts[int(i)].as_py()), self.dtype)
        if whole:
            texts = pc.if_else(pa.array(odd), _EMPTY, texts)
        if self.drops_space:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            # every text begins with a line feed here, whose id is taken off again
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_EMPTY, texts, _LINE_FEED), "\n", " \n"), " ")
        chunks = lists.flatten().dictionary_encode()
        pool, sizes = self._known(chunks.dictionary)
        # one slice has far fewer than 2^31 ids, so 32-bit places do
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        index = chunks.indices.to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lengths = sizes[index]
        if not self.drops_space:
            lengths[bounds[:-1]] = 0  # the empty chunk before the first line feed
        ids = pool[_places(starts[index], lengths)]
        edges = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        skip = 0 if self.drops_space else len(self.line_feed)
        return [whole[i] if i in whole else ids[edges[i] + skip:edges[i + 1]] for i in range(len(texts))]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One per worker process and tokenizer."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]
