"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, each text scanned once.

Texts are read as UTF-8 bytes: A-Z becomes a-z, every other ASCII byte that isn't a letter or digit a space. Words of the items are
numbered, and the automaton reads these numbers, digit by digit, so a match begins and ends with a word. Of each window of an item the automaton
holds its rarest half (a short item as a whole); where that is found, the match is followed in both directions through the item, and a run
of a window or more is a hit. No window can occur without its half, so nothing is missed, and the automaton has a few nodes for a word
of the items, not some for each word of each window. Matches are mapped back to words and to code points of the original text.

Defined cases. Null or wordless texts have no words and no hits; an item without words has no windows. Items that share a window each
count. A null item_id is written as an empty string. Rows that repeat a doc_id are judged row by row. An empty benchmark hits nothing,
an empty table gives an empty result. Columns that aren't asked for are ignored; names of what is found may not be asked for. Texts are
whole: the memory of a task grows with its longest text, to about a hundred times its bytes.

At scale. One pass over the documents without a shuffle. The items go to every task, which builds the automaton once, so their size is
bounded: `scan_bytes` of text make an automaton of some hundred MB, and only a benchmark of more is scanned for in several passes, with
hits merged row by row. Long items are cut for that into pieces that share all but a word of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import bounded_batches, read_table, row_slices, write_table

WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Text of items that one scan looks for.
SCAN_BYTES = 8 << 20
SPAN = "struct<first_word:int,end_word:int,start:int,end:int>"
SCHEMA = f"n_words long, spans array<{SPAN}>, item_ids array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def rarest_parts(numbers: np.ndarray, ends: np.ndarray, window: int, part: int) -> np.ndarray:
    """Places in the words of all items, one after the other (ends: of each item), such that each window holds a part that starts at one."""
    n = len(numbers) - part + 1
    inside = np.zeros(len(numbers), np.int64)  # of items of a window or more: 1 where a window starts
    begins = np.r_[0, ends[:-1]]
    for a, b in zip(begins[ends - begins >= window].tolist(), ends[ends - begins >= window].tolist(), strict=True):
        inside[a : b - window + 1] = 1
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts
    views = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(numbers, part)).view(f"V{4 * part}").ravel()
    _, which, count = np.unique(views, return_inverse=True, return_counts=True)
    step = window - part + 1
    rank = count[which] * step + np.arange(n) % step  # the fewest holders, then places that lie apart
    choices = np.lib.stride_tricks.sliding_window_view(rank, step)[starts]
    return np.unique(starts + choices.argmin(axis=1))


#: Digits of a word's number: each has few values, as the automaton's nodes keep their branches in lists; the first is told from the others.
DIGITS = 32
_FIRST, _LATER, _UNKNOWN = 0x20, 0x40, "\x60"


def spelled(number: int, width: int) -> str:
    """A word's number in so many digits."""
    later = [chr(_LATER + number // DIGITS**k % DIGITS) for k in range(1, width)]
    return chr(_FIRST + number % DIGITS) + "".join(later)


class Automaton:
    """Parts of windows, as numbers of words, to the items and places that hold them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.window, self.names = window, [item for item, _ in items]
        number: dict[bytes, int] = {}
        self.items = [[number.setdefault(w, len(number)) for w in words_of(text)] for _, text in items]
        self.width = 1
        while DIGITS**self.width < len(number):
            self.width += 1
        spelling = [spelled(k, self.width) for k in range(len(number))]
        self.number, self.spelling = number, dict(zip(number, spelling, strict=True))
        part = max(1, window // 2)
        holders: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, own in enumerate(self.items):
            if 0 < len(own) < window:
                holders.setdefault(tuple(own), []).append((i, 0))
        ends = np.cumsum([len(own) for own in self.items])
        flat = np.fromiter((w for own in self.items for w in own), np.uint32, int(ends[-1]) if len(ends) else 0)
        if len(flat) >= window:
            for at in rarest_parts(flat, ends, window, part).tolist():
                i = int(np.searchsorted(ends, at, side="right"))
                place = at - int(ends[i]) + len(self.items[i])
                holders.setdefault(tuple(self.items[i][place : place + part]), []).append((i, place))
        self.machine = ahocorasick.Automaton()
        for key, held in holders.items():
            self.machine.add_word("".join([spelling[k] for k in key]), (len(key), held))
        self.size = len(holders)
        if holders:
            self.machine.make_automaton()

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words (end excluded) that are windows of items, and whose they are."""
        spelling, unknown = self.spelling, _UNKNOWN * self.width
        matches = list(self.machine.iter("".join([spelling.get(w, unknown) for w in words])))
        if not matches:
            return [], set()
        number = self.number
        text = [number.get(w, -1) for w in words]
        found, names, done = [], set(), {}
        for last, (n, held) in matches:
            end = last // self.width
            start = end - n + 1
            for i, place in held:
                item = self.items[i]
                if len(item) < self.window:
                    if n == len(item):
                        found.append((start, end + 1))
                        names.add(self.names[i])
                    continue
                shift = start - place
                if done.get((i, shift), 0) > end:
                    continue  # inside the run that was followed before
                a, b = start, end + 1
                low, high = max(0, shift), min(len(text), shift + len(item))
                while a > low and text[a - 1] == item[a - 1 - shift]:
                    a -= 1
                while b < high and text[b] == item[b - shift]:
                    b += 1
                done[i, shift] = b
                if b - a >= self.window:
                    found.append((a, b))
                    names.add(self.names[i])
        return found, names

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], set[str]]:
        """Number of words; runs of hit words with their code points in the text; items."""
        words = words_of(text)
        if not self.size or not words:
            return len(words), [], set()
        found, names = self.runs(words)
        if not found:
            return len(words), [], set()
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, [a for a, _ in found], 1)
        np.add.at(edge, [b for _, b in found], -1)
        hit = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0]
        first, last = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        raw = np.frombuffer(text, np.uint8)
        inside = np.r_[0, (np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32).astype(np.int8), 0]
        starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        spans = [(int(a), int(b), int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(first, last, strict=True)]
        return len(words), spans, names


def merge_spans(a: list, b: list) -> list[tuple[int, int, int, int]]:
    out: list[list[int]] = []
    for x in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and x[0] <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], x[1]), max(out[-1][3], x[3])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


_BUILT: dict[tuple, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:  # noqa: ANN001
    """A worker builds the automaton once and keeps the last one only."""
    key = (shared.value[0], window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value[1], window)
    return _BUILT[key]


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int, kept: list[str], first: bool) -> DataFrame:
    """docs: the columns to keep, text, and what an earlier scan found unless this is the first."""
    name = hashlib.sha256(repr(items).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((name, items))
    n_kept, text = len(kept), docs.columns.index("text")
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("first_word", "end_word", "start", "end")]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window)
        for b in row_slices(batches, text):
            texts = b.column(text).cast(pa.binary()).to_pylist()
            n, spans, ids = zip(*(automaton.scan(t or b"") for t in texts), strict=True)
            if not first:
                old_spans, old_ids = b.column("spans").to_pylist(), b.column("item_ids").to_pylist()
                spans = [merge_spans([tuple(s.values()) for s in o], x) for o, x in zip(old_spans, spans, strict=True)]
                ids = [x | set(o) for o, x in zip(old_ids, ids, strict=True)]
            records = [[dict(zip(("first_word", "end_word", "start", "end"), s, strict=True)) for s in x] for x in spans]
            yield pa.record_batch([*b.columns[:n_kept], pa.array(n, pa.int64()), pa.array(records, kind), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))], [*kept, "n_words", "spans", "item_ids"])

    schema = ", ".join(f"`{k}` {t}" for k, t in docs.dtypes[:n_kept])
    return docs.mapInArrow(kernel, f"{schema}, {SCHEMA}")


def in_scans(items: Iterator[tuple[str, bytes]], window: int, scan_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of about scan_bytes of text at most; longer items in pieces, of which each window is in one."""
    held, size = [], 0
    for item, text in items:
        pieces = [text]
        if len(text) > scan_bytes:
            words = words_of(text)
            n = max(window, scan_bytes // max(1, len(text) // max(1, len(words))))
            pieces = [b" ".join(words[k : k + n + window - 1]) for k in range(0, max(1, len(words) - window + 1), n)]
        for piece in pieces:
            if held and size + len(piece) > scan_bytes:
                yield held
                held, size = [], 0
            held.append((item, piece))
            size += len(piece)
    yield held


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, scan_bytes: int = SCAN_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, n_words, spans of hit words (end excluded, code points of the text), item_ids (sorted); row by row."""
    bounded_batches(documents.sparkSession)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    scans = in_scans(((r[0], r[1].encode()) for r in rows.toLocalIterator()), window, scan_bytes)
    docs = documents.select(*keep, *(["text"] if "text" not in keep else []))
    items, first = next(scans), True
    while items is not None:
        later = next(scans, None)
        kept = list(keep) if later is None or "text" in keep else [*keep, "text"]
        docs = _scan(docs, items, window, kept, first)
        if later is not None:
            docs = write_table(docs, "scanned")
        items, first = later, False
    return docs


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["first_word"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


NAME = "op4_decontamination"
