"""Suffix-array dedup: bytes covered by a `size`-byte string that also starts anywhere else are removed.

1. Anchors. Of the grams (size // 4 bytes) inside each `size`-byte window, the leftmost with the least hash is the window's anchor, so
   equal windows have equal anchors at equal offsets, and each window belongs to one. An anchor's block is the bytes of its windows.
   Only anchors whose gram occurs twice go on. Blocks that are likely to be equal as a whole (128 bits of BLAKE2b) are one class, for
   which two of its members stand in what follows; what is found of the first is then told of all members.
2. Runs. Members that stand for their class, and blocks that are alone in theirs, are suffixes to be sorted, from the anchor to the end of
   the block, with what stands left of the anchor. Tasks sort those of their documents and front-code them: each suffix is its common prefix with the one before and the rest.
3. Exchange and merge. Runs go to partitions by gram, where a loser tree merges them: it compares the lengths of known common prefixes
   with the last suffix put out, and bytes only beyond equal ones, so no known prefix is compared again. It gives the common prefix of
   neighbours for free.
4. Groups. Neighbours with a common prefix of a gram or more form a group. Each of its suffix intervals (neighbours with r bytes in common
   right of the anchor) is ordered by what stands left; a suffix repeats from its longest common part with a neighbour there to r.

Defined cases. Null counts as empty; texts of fewer bytes than `size` have no windows. Rows that repeat a doc_id are documents of their
own, so all of a repeated row (of `size` bytes or more) is removed. Null doc_ids are kept. An empty table gives an empty result. Removal
may cut inside a character: what is kept is bytes. Other columns are ignored. Texts are whole: a long one is anchored piece by piece, but
is in one row where its blocks are cut out and where it is put together again, so it has to fit a task a few times.

At scale. Anchors are one for about 150 bytes, and only repeated ones are shuffled a second time. Copies and common passages collapse
into classes by partial aggregation, so the merge gets two suffixes of each, and joins deal the rows of a hot gram, block or group to several tasks. A gram with over `max_group` classes (a passage with as many different surroundings) is parted by the
bytes about it: a window reaches o bytes left of its anchor, so those with o in the lower half of the range share more bytes on the right
and those in the upper half more on the left, and classes are dealt to both halves by the bytes that all windows of a half have. Halves
that are still too large are halved again, down to single windows, which repeat if two are equal (128 bits of BLAKE2b). The number of sort
partitions grows with the number of suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, bytes_of, partitions, read_table, row_slices
from riverstone.llm.hashing import mixed, powers, prefix_sums

SIZE = 400
MAX_GROUP = 20_000
#: Bytes of a group's key before each suffix, so that groups of one gram that were parted stay apart.
KEY = 8
SUFFIXES_PER_PART = 20_000
#: Rows of a key that one task of a join takes without dealing them to more.
HOT = 1_000
CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by running minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Row, first window's start in the text, windows, anchor's place in the block and gram hash, of each anchor."""
    gram = size // 4
    w = size - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(data) - size + 1, 0), CHUNK):
        piece = data[at : at + CHUNK + size - 1]
        total, down = prefix_sums(piece), powers(len(piece) + 1)[1]
        n = len(piece) - gram + 1
        g = mixed((total[gram:] - total[:n]) * down[:n])
        least = sliding_least((g & ~_LOW) | np.arange(n, dtype=np.uint64), w)
        anchor = (least & _LOW).astype(np.int64)
        start = np.arange(len(anchor))
        row = np.searchsorted(offsets, start + at, side="right") - 1
        inside = start + at + size <= offsets[row + 1]
        start, anchor, row = start[inside], anchor[inside], row[inside]
        if not len(start):
            continue
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])])
        first, windows = start[cut], np.diff(np.r_[cut, len(start)])
        found.append((row[cut], first + at - offsets[row[cut]], windows, anchor[cut] - first, g[anchor[cut]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)


def digest(data: bytes) -> tuple[int, int]:
    x = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def find_grams(docs: DataFrame, size: int) -> DataFrame:
    """The gram of each anchor."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 0, max_bytes=1 << 20):
            yield pa.record_batch([pa.array(anchors_of(*bytes_of(b.column(0)), size)[4].view(np.int64))], ["gram"])

    return docs.select("text").mapInArrow(kernel, "gram long")


def find_anchors(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, th (hash of the text), text) to its anchors, with a digest of each one's block and its place there."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 2, max_bytes=1 << 20):
            data, offsets = bytes_of(b.column(2))
            row, start, windows, place, g = anchors_of(data, offsets, size)
            if len(row):
                raw, first = data.tobytes(), offsets[row] + start
                spans = zip(place.astype("<u4").tolist(), first.tolist(), (first + windows - 1 + size).tolist(), strict=True)
                block = np.array([digest(p.to_bytes(4, "little") + raw[i:j]) for p, i, j in spans], np.int64)
                at = pa.array(row)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(block[:, 0].copy()), pa.array(block[:, 1].copy())], ["doc_id", "th", "start", "windows", "place", "gram", "b1", "b2"])

    return docs.mapInArrow(kernel, "doc_id long, th long, start long, windows int, place int, gram long, b1 long, b2 long")


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix; the first `at` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted suffixes as common prefixes with the one before, and the rests."""
    before, shared, rest = b"", [], []
    for s in suffixes:
        n = common_prefix(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


class LoserTree:
    """Merges front-coded sorted runs; gives (common prefix with the one before, suffix, run, place in the run).

    A player holds the length of its common prefix with the suffix put out last. Of two players the one with the longer is smaller;
    only if both are alike are bytes compared, from there on, and the loser keeps the common prefix with the winner.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * len(runs)
        self.suffix: list[bytes | None] = [rest[0] if rest else None for _, rest in runs] + [None] * (self.k - len(runs))
        self.known = [0] * self.k
        self.loser = [-1] * self.k

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        sa, sb = self.suffix[a], self.suffix[b]
        if sa is None or sb is None:
            return (b, a) if sa is None else (a, b)
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        n = common_prefix(sa, sb, ka)
        if sa[n : n + 1] <= sb[n : n + 1]:
            self.known[b] = n
            return a, b
        self.known[a] = n
        return b, a

    def _start(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        winner, self.loser[node] = self._play(self._start(2 * node), self._start(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        champion = self._start(1) if self.k > 1 else 0
        while (s := self.suffix[champion]) is not None:
            place = self.at[champion]
            yield self.known[champion], s, champion, place
            shared, rest = self.runs[champion]
            self.at[champion] = place = place + 1
            if place < len(rest):
                self.known[champion] = shared[place]
                self.suffix[champion] = s[: shared[place]] + rest[place]
            else:
                self.suffix[champion] = None
            node = (champion + self.k) >> 1
            while node:
                champion, self.loser[node] = self._play(champion, self.loser[node])
                node >>= 1


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """The suffix intervals of a group in sorted order: common prefix, first, last; inner ones before outer ones. shared[i]: of i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(shared) + 1):
        n = shared[i] if i < len(shared) else -1
        begin = i - 1
        while stack and stack[-1][0] > n:
            r, begin = stack.pop()
            yield r, begin, i - 1
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, begin))


def repeated_in_group(lefts: list[bytes], shared: list[int], is_open: list[bool], size: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a group, in sorted order, ranges (from, to) about its anchor that repeat; closed ones get none.

    lefts: bytes left of the anchor; shared[i]: common prefix of suffixes i - 1 and i.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in lefts]
    back = [x[::-1] for x in lefts]
    rank = [0] * len(back)
    for place, i in enumerate(sorted(range(len(back)), key=back.__getitem__)):
        rank[i] = place
    for r, begin, end in intervals(shared):
        need = size - r
        asked = [i for i in range(begin, end + 1) if len(back[i]) >= need]
        if len(asked) < 2 or not any(is_open[i] for i in asked):
            continue
        asked.sort(key=rank.__getitem__)
        before = -1
        for k, i in enumerate(asked):
            after = common_prefix(back[i], back[asked[k + 1]]) if k + 1 < len(asked) else -1
            if is_open[i] and max(before, after) >= max(need, 0):
                out[i].append((-max(before, after), r))
            before = after
    return [merged(x) for x in out]


RUN = "part int, shared array<int>, rest array<binary>, lefts array<binary>, doc_id array<long>, th array<long>, anchor array<long>, is_open array<boolean>, number array<long>"
_RUN_TYPES = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
_RUN_NAMES = ["part", "shared", "rest", "lefts", "doc_id", "th", "anchor", "is_open", "number"]
#: Ranges about an anchor that repeat, and the class that they hold for (null: the block alone).
FOUND = "doc_id long, th long, anchor long, a long, b long, number long"


def _sorted_runs(size: int, run_bytes: int = 16 << 20):
    """doc_id, th, text, blocks array<struct<part, key, start, windows, place, is_open, number>> to sorted, front-coded runs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        weight, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for part, own in held.items():
                own.sort(key=lambda x: x[0])
                suffixes, *beside = map(list, zip(*own, strict=True))
                rows.append((part, *front_coded(suffixes), *beside))
            for i in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), _RUN_TYPES, strict=True)], _RUN_NAMES)

        for b in row_slices(batches, 2, max_rows=256):
            texts = b.column(2).cast(pa.binary())
            for i, (doc, th, blocks) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if (doc, th) in seen:  # a repeated row, whose blocks are here already
                    continue
                seen.add((doc, th))
                text = texts[i].as_py()
                for x in blocks:
                    start, anchor = x["start"], x["start"] + x["place"]
                    end = start + x["windows"] - 1 + size
                    suffix = x["key"].to_bytes(KEY, "little", signed=True) + text[anchor:end]
                    held.setdefault(x["part"], []).append((suffix, text[start:anchor], doc, th, anchor, x["is_open"], x["number"]))
                    weight += end - start + 200
                if weight > run_bytes:
                    yield from flush()
                    held, weight = {}, 0
        if held:
            yield from flush()

    return kernel


def _merge(size: int):
    gram = KEY + size // 4

    def kernel(key, table):  # noqa: ANN001, ANN202
        """Merges a partition's runs and gives the repeated ranges of its documents."""
        runs = [(a, b) for a, b in zip(table.column("shared").to_pylist(), table.column("rest").to_pylist(), strict=True)]
        lefts, doc, th, anchor, is_open, number = (table.column(k).to_pylist() for k in ("lefts", "doc_id", "th", "anchor", "is_open", "number"))
        out: list[tuple] = []
        group: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(group) > 1 and any(is_open[r][i] for _, r, i in group):
                found = repeated_in_group([lefts[r][i] for _, r, i in group], [k - KEY for k, _, _ in group], [is_open[r][i] for _, r, i in group], size)
                for (_, r, i), ranges in zip(group, found, strict=True):
                    out.extend((doc[r][i], th[r][i], anchor[r][i], a, b, number[r][i]) for a, b in ranges)

        for shared, _, run, place in LoserTree(runs):
            if shared < gram:
                close()
                group = []
            group.append((shared, run, place))
        close()
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "th", "anchor", "a", "b", "number"), cols, strict=True)})

    return kernel


def _halved(size: int):
    """doc_id, th, text, blocks (with the range lo to hi of bytes left of the anchor) to the blocks of both halves, with keys of the bytes there."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in row_slices(batches, 2, max_rows=256):
            texts, rows = b.column(2).cast(pa.binary()), []
            for i, (doc, th, blocks) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if (doc, th) in seen:
                    continue
                seen.add((doc, th))
                text = texts[i].as_py()
                for x in blocks:
                    anchor, middle = x["start"] + x["place"], (x["lo"] + x["hi"]) // 2
                    for lo, hi in ((x["lo"], middle), (middle + 1, x["hi"])):
                        if lo <= min(hi, x["place"]) and hi > x["place"] - x["windows"]:
                            rows.append((doc, th, *digest(text[anchor - lo : anchor + size - hi]), lo, hi, x["start"], x["windows"], x["place"], x["is_open"], x["number"]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, *[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 2, pa.bool_(), pa.int64()), strict=True)], ["doc_id", "th", "key", "key2", "lo", "hi", "start", "windows", "place", "is_open", "number"])

    return kernel


HALVES = "doc_id long, th long, key long, key2 long, lo int, hi int, start long, windows int, place int, is_open boolean, number long"


def repeated_ranges(documents: DataFrame, size: int = SIZE, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, th, start, end: ranges of bytes that repeat, overlapping ones too. th is xxhash64 of the text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with Tables(spark) as tables:
        return tables.write(_repeated_ranges(documents.select("doc_id", "th", "text"), size, max_group, tables), "ranges", keep=True)


def dealt_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keys, a stored table with one row for each value of `on`, n of whose rows there are at most.

    A key of many rows is dealt by the columns `by` to several tasks and stands there once each. Keys are hot from a share of all rows on,
    so there are fewer than 4 of them for each partition: that many are broadcast, and copies of keys are fewer than 4 a partition too.
    """
    share = 4 * partitions(rows.sparkSession)
    total = keys.agg(F.sum(n)).first()[0] or 0
    most = max(HOT, total // share)
    tasks = F.ceil(F.col(n) / most).cast("int")
    hot = keys.filter(F.col(n) > most).select(*on, tasks.alias("dealt_to"))
    task = F.coalesce(F.pmod(F.xxhash64(*by), F.col("dealt_to")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("dealt", task).drop("dealt_to")
    copies = keys.withColumn("dealt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt.join(copies, [*on, "dealt"], how).drop("dealt")


def _repeated_ranges(docs: DataFrame, size: int, max_group: int, tables: Tables) -> DataFrame:
    twice = tables.write(find_grams(docs, size).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    anchors = tables.write(dealt_join(find_anchors(docs, size), twice, ["gram"], "n", ["doc_id", "th", "start"], "left_semi"), "anchors")
    block, own = ["gram", "b1", "b2", "windows"], F.struct("doc_id", "th", "start")
    # Numbers stay, as the table is written.
    classes = anchors.groupBy(*block).agg(F.count("*").alias("n"), F.min(own).alias("one"), F.max(own).alias("other"), F.first("place").alias("place"))
    classes = tables.write(classes.withColumn("number", F.when(F.col("n") > 1, F.monotonically_increasing_id())), "classes")
    # Only the first of the two is asked for; the other is what it is compared with, beside the blocks of the gram's other classes.
    asked = lambda k, is_open: F.struct(f"{k}.*", F.lit(is_open).alias("is_open"))
    members = F.explode(F.when(F.col("n") > 1, F.array(asked("one", True), asked("other", False))).otherwise(F.array(asked("one", True))))
    rivals = classes.select("gram", "windows", "place", "number", members.alias("member")).select(F.col("gram").alias("key"), F.lit(0).cast("long").alias("key2"), F.lit(0).alias("lo"), F.lit(size - size // 4).alias("hi"), "member.*", "windows", "place", "number")
    group = ["key", "key2", "lo", "hi"]

    def with_text(rows: DataFrame, *made: str) -> DataFrame:
        own = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*made, "start", "windows", "place", "is_open", "number")).alias("blocks"))
        same = docs["doc_id"].eqNullSafe(own["doc_id"]) & (docs["th"] == own["th"])
        return docs.join(own, same).select(docs["doc_id"], docs["th"], "text", "blocks")

    found, small = None, None
    level = 0
    while True:
        rivals = tables.write(rivals, f"rivals-{level}")
        sizes = rivals.groupBy(*group).agg(F.count("*").alias("members"), F.max("is_open").alias("some_open")).filter("members > 1 and some_open").drop("some_open")
        sizes = tables.write(sizes, f"sizes-{level}")
        counted = dealt_join(rivals, sizes, group, "members", ["doc_id", "th", "start"])
        fit = counted.filter(f"members <= {max_group} and lo < hi").drop("members")
        small = fit if small is None else small.unionByName(fit)
        anchor = (F.col("start") + F.col("place")).alias("anchor")
        single = counted.filter("lo = hi and is_open").select("doc_id", "th", anchor, (-F.col("lo")).cast("long").alias("a"), (F.lit(size) - F.col("lo")).cast("long").alias("b"), "number")
        found = single if found is None else found.unionByName(single)
        over = sizes.filter(f"members > {max_group} and lo < hi")
        if over.isEmpty():
            break
        rivals = with_text(dealt_join(rivals, over, group, "members", ["doc_id", "th", "start"]).drop("members"), "lo", "hi").mapInArrow(_halved(size), HALVES)
        level += 1
    small = tables.write(small, "suffixes")
    parts = max(partitions(docs.sparkSession), small.count() // SUFFIXES_PER_PART)
    part = F.pmod(F.xxhash64("key", "key2"), F.lit(parts)).cast("int").alias("part")
    runs = with_text(small.withColumn("part", part), "part", "key").mapInArrow(_sorted_runs(size), RUN)
    found = tables.write(found.unionByName(runs.groupBy("part").applyInArrow(_merge(size), FOUND)), "found")
    # What was found of one member of a class holds for all: they have the same bytes about their anchors.
    told = found.filter("number is not null").groupBy("number").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    told = tables.write(classes.filter("n > 1").select(*block, "n", "number").join(told, "number"), "told")
    all_members = dealt_join(anchors, told, block, "n", ["doc_id", "th", "start"]).select("doc_id", "th", (F.col("start") + F.col("place")).alias("anchor"), F.explode("ranges").alias("r")).select("doc_id", "th", "anchor", "r.*")
    ranges = found.filter("number is null").select("doc_id", "th", "anchor", "a", "b").unionByName(all_members)
    return ranges.select("doc_id", "th", (F.col("anchor") + F.col("a")).alias("start"), (F.col("anchor") + F.col("b")).alias("end"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ranges_of(ranges: DataFrame) -> DataFrame:
    """doc_id, th, ranges: the different ranges of each text; those of repeated rows are the same, and are told once from each task on."""
    return ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def suffix_dedup(documents: DataFrame, size: int = SIZE, max_group: int = MAX_GROUP, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>> (removed bytes), kept (binary, null unless asked for), kept_sha256."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = repeated_ranges(docs, size, max_group)
    per_doc = ranges_of(ranges)
    same = docs["doc_id"].eqNullSafe(per_doc["doc_id"]) & (docs["th"] == per_doc["th"])
    placed = docs.join(per_doc, same, "left").select(docs["doc_id"], "text", "ranges")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1):
            rows = []
            for raw, found in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = merged([(x["start"], x["end"]) for x in found or []])
                edges = [0, *(e for s in spans for e in s), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if spans else raw
                rows.append((len(raw), [{"start": s, "end": e} for s, e in spans], kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
            n, spans, kept, sha = zip(*rows, strict=True)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(sha)], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    return placed.mapInArrow(kernel, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(read_table(spark, sf_dir, "documents"), keep_bytes=False)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


NAME = "op2_suffix_dedup"
