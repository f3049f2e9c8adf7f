"""Token ids of whole texts, by a public tokenizer file, with a cache of words.

The tokenizer puts texts in lower case, drops white space, and splits them into runs of letters, single digits, runs of other signs and a
few endings after an apostrophe, which it encodes one by one. For texts of Latin-1 characters that split is made here in numpy, parts are
looked up by a 64-bit hash, and each part is encoded once and kept in a bounded cache of the Python worker. The bytes behind equal hashes
are compared, in the batch and in the cache; if some differ, the batch goes to the tokenizer whole. Other texts are cut at spaces only,
where the tokenizer never joins; texts that hold the mark of a special token go to the tokenizer whole. A text is taken whole however long
it is: the memory of a task grows with its longest text, to some fifty times its bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from riverstone.llm.common import row_slices
from riverstone.llm.hashing import equal_segments, segment_hashes

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Parts that a worker keeps, some 30 bytes each; beyond that it starts anew.
CACHE_PARTS = 1_500_000
#: Words of texts that aren't Latin-1 that a worker keeps.
CACHE_WORDS = 50_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
SPACE, LETTER, DIGIT, OTHER = range(4)


def _kind(b: int) -> int:
    c = chr(b)
    if c in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return LETTER if c.isalpha() else DIGIT if c.isnumeric() else OTHER


_KIND = np.array([_kind(b) for b in range(256)], np.uint8)


def split_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of lower-case Latin-1 text that ends with three spaces at least."""
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(data == ord("'"))
    at = at[new[at]]
    if len(at):  # an apostrophe that begins a part takes these letters with it
        one, two = data[at + 1], data[at + 2]
        short = at[np.isin(one, list(b"stmd"))]
        long = at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
        new[short + 1], new[short + 2] = False, True
        new[long + 1], new[long + 3] = False, True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] != SPACE
    return starts[real], ends[real]


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """A vocabulary's place on this machine; an absolute path stays as it is."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class IdTable:
    """Ids of parts by hash, in arrays: sorted keys, where in one array of ids each key's begin and how many there are, and the same for its bytes."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.byte_start, self.n_bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(0, np.uint16), np.zeros(0, np.uint8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where sorted keys are, -1 for those that aren't there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def holds(self, places: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the parts at these places have the bytes data[starts:ends]."""
        n = ends - starts
        return bool((self.n_bytes[places] == n).all() and equal_segments(self.bytes, self.byte_start[places], data, starts, n).all())

    def add(self, keys: np.ndarray, parts: list[bytes], ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        start = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        flat = np.fromiter((i for own in ids for i in own), np.uint32, int(size.sum()))
        if len(flat) and flat.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        self.ids = np.concatenate([self.ids, flat.astype(self.ids.dtype)])
        joined = np.concatenate([self.keys, keys])
        order = np.argsort(joined, kind="stable")
        self.keys = joined[order]
        self.start, self.size = np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        at = len(self.bytes) + np.cumsum(n) - n
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(parts), np.uint8)])
        self.byte_start, self.n_bytes = np.concatenate([self.byte_start, at])[order], np.concatenate([self.n_bytes, n])[order]


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, cache_parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.table, self.cache_parts = IdTable(), cache_parts
        self.words: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 4096):
            for e in self.model.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                yield e.ids

    def _by_words(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        fresh = [w for w in dict.fromkeys(words) if w not in self.words]
        self.words.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(fresh, self._encoded(fresh), strict=True))
        return b"".join(map(self.words.__getitem__, words))

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join([*texts, b"\n\n"]).translate(_LOWER)
        data = np.frombuffer(joined, np.uint8)
        starts, ends = split_parts(data)
        keys, first, part = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.table.keys) > self.cache_parts:
            self.table = IdTable()
        fresh = np.flatnonzero(self.table.places(keys) < 0)
        if len(fresh):
            some = first[fresh]
            parts = [joined[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            self.table.add(keys[fresh], parts, list(self._encoded([p.decode("latin-1") for p in parts])))
        place = self.table.places(keys)
        n = ends - starts
        alike = bool((n == n[first[part]]).all()) and equal_segments(data, starts, data, starts[first[part]], n).all()
        if not alike or not self.table.holds(place, data, starts[first], ends[first]):
            return [np.array(ids, "<u4").tobytes() for ids in self._encoded([t.decode("latin-1") for t in texts])]
        start, count = self.table.start[place][part], self.table.size[place][part].astype(np.int64)
        before = np.cumsum(count) - count
        whole = self.table.ids[np.repeat(start - before, count) + np.arange(int(count.sum()))].astype("<u4").tobytes()
        text_at = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = 4 * np.append(before, len(whole) // 4)[np.searchsorted(starts, text_at)]
        return [whole[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        latin: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            if "<|" in t:
                out[i] = np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            try:
                latin.append((i, t.encode("latin-1")))
            except UnicodeEncodeError:
                out[i] = self._by_words(t)
        if latin:
            for (i, _), ids in zip(latin, self._latin([t for _, t in latin]), strict=True):
                out[i] = ids
        return out


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str) -> WordTokenizer:
    """A Python worker loads a vocabulary once."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = WordTokenizer(vocabulary)
    return _LOADED[vocabulary]


def encoded(batches: Iterator[pa.RecordBatch], text_col: int, vocabulary: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches and the ids of their texts; null counts as empty."""
    words = tokenizer(vocabulary)
    for b in row_slices(batches, text_col, max_rows=512):
        yield b, words.encode([t or "" for t in b.column(text_col).to_pylist()])
