"""Ranked lexical search: documents reordered by recursive graph bisection, and a clustered index whose shards are visited by their bounds.

1. Terms. One pass over the texts keeps, of each document, its length and the frequencies of the terms that the queries hold. Totals and
   document frequencies follow from that table.
2. Order. Documents are dealt to ranges by their rarest term (its hash), then by a hash of their own. In each block of at most
   `block` documents of a range, recursive graph bisection puts documents that share terms next to each other: a range is halved, and
   documents of both halves are swapped in order of the gain in log-gap cost, until no swap gains; then each half is bisected.
3. Index. `shard` neighbours make a shard: its postings by term, the impact of each, and the largest impact of each term.
4. Search. A query's bound of a shard is the sum of its terms' weights times these largest impacts. Each task visits its shards from the
   highest bound down and stops at the first whose bound is below the k-th score so far: what is left can't come among the k, not by a tie
   either. Documents are reported by doc_id, and ties go to the smaller. A share of the blocks is searched first; the k-th scores there are
   where the others start from.

Defined cases. Null texts have no terms; such documents count nowhere, and such items give no rows. Rows that repeat a doc_id are documents
of their own, items that repeat an item_id are queries of their own. Null doc_ids come after all others of the same score. Fewer than k
documents with a score above 0 are all given. Without documents or items there are no rows. Other columns are ignored. Texts are cut into
terms whole: a task takes some twenty times its longest text.

At scale. Texts are read once and never shuffled; what is dealt to ranges are the queries' terms in each document. Queries go to all tasks
in chunks of `query_bytes` of text, each with its own pass, so nothing broadcast grows with them. A task holds one block while it is ordered
and `visit_bytes` of shards while it searches, whatever the size of a range, and gives at most k rows for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, partitions, read_table, row_slices, write_table
from riverstone.llm.hashing import BASE, mixed

K = 50
BLOCK = 4096
SHARD = 64
QUERY_BYTES = 8 << 20
VISIT_BYTES = 32 << 20
#: One in so many blocks is searched first.
FIRST = 8
ROUNDS = 12
_ALONE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_ID = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    """Letters and digits in lower case (A-Z only), other characters beyond ASCII as they are."""
    return text.translate(_ALONE).split()


@dataclass
class Queries:
    """A chunk of queries: item_ids, each one's distinct terms (numbers, from at[i] to at[i + 1]) and the number of each term."""

    item_ids: list
    terms: np.ndarray
    at: np.ndarray
    number: dict[bytes, int]
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, items: list[tuple]) -> Queries:
        own = [(i, sorted(set(terms_of((t or "").encode())))) for i, t in items]
        own = [x for x in own if x[1]]
        number = {t: k for k, t in enumerate(sorted({t for _, ts in own for t in ts}))}
        at = np.cumsum([0] + [len(ts) for _, ts in own])
        return cls([i for i, _ in own], np.array([number[t] for _, ts in own for t in ts], np.int64), at, number)

    @property
    def n(self) -> int:
        return len(self.item_ids)


def chunks(items: DataFrame, query_bytes: int) -> Iterator[Queries]:
    """The queries, some megabytes of text at a time."""
    held, size = [], 0
    for item, text in items.select("item_id", "text").toLocalIterator():
        held.append((item, text))
        size += len(text or "") + 64
        if size >= query_bytes:
            yield Queries.of(held)
            held, size = [], 0
    if held:
        yield Queries.of(held)


def forward(documents: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (all terms with repeats), terms (numbers of those that queries hold, ascending), tf: of documents with a term."""
    shared = documents.sparkSession.sparkContext.broadcast(queries.number)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in row_slices(batches, 1, max_bytes=1 << 20):
            rows = []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text or b"")
                if words:
                    known = [k for k in map(number.get, words) if k is not None]
                    term, tf = np.unique(np.array(known, np.int32), return_counts=True)
                    rows.append((i, len(words), term.tobytes(), tf.astype(np.int32).tobytes()))
            if rows:
                i, n, term, tf = zip(*rows, strict=True)
                yield pa.record_batch([b.column(0).take(pa.array(i)), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, n long, terms binary, tf binary")


def frequencies(docs: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each of the queries' terms; each task adds up its own."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        if len(some):
            yield pa.record_batch([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in docs.select("terms").mapInArrow(kernel, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # a row for each term of a chunk of queries
        out[term] = df
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def bisected(terms: np.ndarray, at: np.ndarray, shard: int = SHARD, rounds: int = ROUNDS) -> np.ndarray:
    """An order of documents (CSR of term numbers) in which those that share terms are neighbours, by recursive graph bisection."""
    order = np.arange(len(at) - 1)
    used, local = np.unique(terms, return_inverse=True)
    size = np.diff(at)

    def split(begin: int, end: int) -> None:
        if end - begin <= shard:
            return
        half = begin + max(1, (end - begin) // shard // 2) * shard  # halves are whole shards
        docs = order[begin:end]
        count = size[docs]
        doc = np.repeat(np.arange(len(docs)), count)
        own = local[np.repeat(at[docs] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        n = np.array([half - begin, end - half])
        right = np.arange(len(docs)) >= n[0]
        for _ in range(rounds):
            deg = np.stack([np.bincount(own[~right[doc]], minlength=len(used)), np.bincount(own[right[doc]], minlength=len(used))]).astype(np.float64)
            cost = lambda d, size: d * np.log2(size / (d + 1))
            now = cost(deg[0], n[0]) + cost(deg[1], n[1])
            to_right = now - cost(deg[0] - 1, n[0]) - cost(deg[1] + 1, n[1])
            to_left = now - cost(deg[0] + 1, n[0]) - cost(deg[1] - 1, n[1])
            gain = np.bincount(doc, weights=np.where(right[doc], to_left[own], to_right[own]), minlength=len(docs))
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            m = min(len(a), len(b))
            swaps = int(np.argmin(np.append(gain[a[:m]] + gain[b[:m]] > 1e-9, False)))
            if not swaps:
                break
            right[a[:swaps]], right[b[:swaps]] = True, False
        order[begin:end] = np.concatenate([docs[~right], docs[right]])
        split(begin, half)
        split(half, end)

    with np.errstate(divide="ignore", invalid="ignore"):  # of terms that a half hasn't got, which nothing reads
        split(0, len(order))
    return order


SHARDS = "block long, docs binary, terms binary, most binary, edges binary, posting_doc binary, posting_impact binary"


def _index(total: int, n_docs: int, block: int, shard: int, rounds: int):
    """A range's rows to shards: its documents in blocks, each reordered, cut and inverted."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, number = 0, TaskContext.get().partitionId() << 24
        for b in batches:
            begin = 0
            while begin < b.num_rows:
                piece = b.slice(begin, block - rows)
                held.append(piece)
                begin, rows = begin + piece.num_rows, rows + piece.num_rows
                if rows == block:
                    yield shards(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
        if held:
            yield shards(pa.Table.from_batches(held), number)

    def shards(table: pa.Table, number: int) -> pa.RecordBatch:
        ids, n = table.column("doc_id").fill_null(NO_ID).to_numpy(), table.column("n").to_numpy()
        null = table.column("doc_id").is_null().to_numpy()
        lists = [np.frombuffer(x, np.int32) for x in table.column("terms").to_pylist()]
        terms, at = np.concatenate(lists), np.cumsum([0] + [len(x) for x in lists])
        tf = np.frombuffer(b"".join(table.column("tf").to_pylist()), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        m = 50 + (50 * n * n_docs) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        order = bisected(terms, at, shard, rounds)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        where = place[doc]
        by = np.lexsort((where, terms, where // shard))
        edges = np.searchsorted(where[by] // shard, np.arange(-(-len(order) // shard) + 1))
        out = []
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            own, docs = by[i:j], order[k * shard : (k + 1) * shard]
            used, first = np.unique(terms[own], return_index=True)
            most = np.maximum.reduceat(impact[own], first) if len(own) else impact[own]
            out.append((number, np.stack([ids[docs], null[docs]]).astype(np.int64).tobytes(), used.astype(np.int32).tobytes(), most.astype(np.int32).tobytes(), np.append(first, len(own)).astype(np.int32).tobytes(), (where[own] - k * shard).astype(np.int32).tobytes(), impact[own].astype(np.int32).tobytes()))
        kinds = [pa.int64(), *[pa.binary()] * 6]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])

    return kernel


def build_index(docs: DataFrame, df: np.ndarray, total: int, n_docs: int, block: int = BLOCK, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """forward() rows to shards (SHARDS), reordered in blocks of at most `block` neighbours of a range."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for x in b.column(2).to_pylist():
                t = np.frombuffer(x, np.int32)
                keys.append(int(t[np.argmin(df[t])]))
            key = mixed(np.array(keys, np.uint64) * BASE).view(np.int64)
            yield pa.record_batch([*b.columns, pa.array(key)], [*b.schema.names, "key"])

    schema = "doc_id long, n long, terms binary, tf binary, key long"
    ranges = max(1, min(math.ceil(n_docs / block), 8 * partitions(docs.sparkSession)))
    own = F.xxhash64("doc_id", "n", "terms", "tf")
    dealt = docs.filter(F.length("terms") > 0).mapInArrow(keyed, schema).repartitionByRange(ranges, "key", own).sortWithinPartitions("key", own)
    return dealt.mapInArrow(_index(total, n_docs, block, shard, rounds), SHARDS)


class Searcher:
    """Searches shards held by a task for a chunk of queries, from thresholds (the k-th score that each query has elsewhere)."""

    def __init__(self, queries: Queries, k: int, floor: np.ndarray):
        self.q, self.k = queries, k
        self.own_weight = queries.weight[queries.terms]
        self.floor = np.maximum(floor, 1)  # a score of 0 doesn't count
        self.scores = np.zeros((queries.n, k), np.int64)
        self.ids = np.full((queries.n, k), NO_ID)
        self.null = np.ones((queries.n, k), np.int64)
        self.visited = self.offered = 0

    def threshold(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def visit(self, rows: list[dict]) -> None:
        """Shards by bounds, until no query's next bound reaches its threshold."""
        dense = np.zeros(len(self.q.number), np.int64)
        bounds = np.empty((self.q.n, len(rows)), np.int64)
        parts = [tuple(np.frombuffer(r[k], np.int32) for k in ("terms", "most", "edges", "posting_doc", "posting_impact")) for r in rows]
        for s, (terms, most, *_) in enumerate(parts):
            dense[terms] = most
            bounds[:, s] = np.add.reduceat(dense[self.q.terms] * self.own_weight, self.q.at[:-1])
            dense[terms] = 0
        order = np.argsort(-bounds, axis=1, kind="stable")
        self.offered += bounds.size
        active = np.arange(self.q.n)
        for place in range(len(rows)):
            shard = order[active, place]
            active = active[bounds[active, shard] >= self.threshold()[active]]
            if not len(active):
                break
            shard = order[active, place]
            self.visited += len(active)
            for s in np.unique(shard).tolist():
                self._score(active[shard == s], rows[s], *parts[s])

    def _score(self, asked: np.ndarray, row: dict, terms: np.ndarray, most: np.ndarray, edges: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        ids, null = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
        table = np.zeros((len(terms) + 1, len(ids)), np.int64)  # the last for terms that the shard hasn't got
        table[np.repeat(np.arange(len(terms)), np.diff(edges)), doc] = impact
        for i in range(0, len(asked), 256):
            some = asked[i : i + 256]
            begin, count = self.q.at[some], self.q.at[some + 1] - self.q.at[some]
            first = np.r_[0, np.cumsum(count)[:-1]]
            at = np.repeat(begin - first, count) + np.arange(count.sum())
            term = self.q.terms[at]
            there = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
            there = np.where(terms[there] == term, there, len(terms)) if len(terms) else np.zeros(len(term), np.int64)
            score = np.add.reduceat(table[there] * self.own_weight[at][:, None], first)
            better = (score >= self.threshold()[some][:, None]).any(axis=1)
            some, score = some[better], score[better]
            if not len(some):
                continue
            scores = np.concatenate([self.scores[some], np.where(score >= self.floor[some][:, None], score, 0)], axis=1)
            all_ids = np.concatenate([self.ids[some], np.broadcast_to(ids, score.shape)], axis=1)
            nulls = np.concatenate([self.null[some], np.broadcast_to(null, score.shape)], axis=1)
            best = np.lexsort((all_ids, nulls, -scores), axis=1)[:, : self.k]
            for mine, both in ((self.scores, scores), (self.ids, all_ids), (self.null, nulls)):
                mine[some] = np.take_along_axis(both, best, axis=1)

    def found(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.scores)
        ids = pa.array(self.ids[q, place], mask=self.null[q, place].astype(bool))
        return pa.record_batch([pa.array(q), ids, pa.array(self.scores[q, place])], ["query", "doc_id", "score"])


def visited(index: DataFrame, queries: Queries, k: int, floor: np.ndarray, visit_bytes: int = VISIT_BYTES) -> DataFrame:
    """Each task's best documents: query, doc_id, score, at most k for each query."""
    shared = index.sparkSession.sparkContext.broadcast((queries, floor))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value[0], k, shared.value[1])
        rows, size = [], 0
        for b in batches:
            for row in b.to_pylist():
                rows.append(row)
                size += sum(len(x) for x in row.values() if isinstance(x, bytes)) + 8 * searcher.q.n
                if size > visit_bytes:
                    searcher.visit(rows)
                    rows, size = [], 0
        if rows:
            searcher.visit(rows)
        yield searcher.found()

    return index.mapInArrow(kernel, "query long, doc_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    """query, doc_id, score and rank: the k best of each query."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD, query_bytes: int = QUERY_BYTES, visit_bytes: int = VISIT_BYTES, first: int = FIRST, rounds: int = ROUNDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = documents.sparkSession
    bounded_batches(spark)
    kind = items.schema["item_id"].dataType
    out = None
    for queries in chunks(items, query_bytes):
        if queries.n:
            made = _searched(documents, queries, k, block, shard, visit_bytes, first, rounds)
            names = spark.createDataFrame(list(enumerate(queries.item_ids)), "query long, item_id " + kind.simpleString())
            # As many rows as the chunk has queries.
            named = made.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
            out = named if out is None else out.unionByName(named)
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out


def _searched(documents: DataFrame, queries: Queries, k: int, block: int, shard: int, visit_bytes: int, first: int, rounds: int) -> DataFrame:
    """query, doc_id, score, rank of a chunk of queries."""
    spark = documents.sparkSession
    with Tables(spark) as tables:
        docs = tables.write(forward(documents, queries), "forward")
        n_docs, total = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(docs, len(queries.number))
        queries.weight = weights(df, n_docs)
        index = tables.write(build_index(docs, df, max(total, 1), n_docs, block, shard, rounds), "shards")
        early = F.pmod(F.xxhash64("block"), F.lit(first)) == 0
        floor = np.zeros(queries.n, np.int64)
        begun = tables.write(best(visited(index.filter(early), queries, k, floor, visit_bytes), k), "first")
        for query, score in begun.filter(F.col("rank") == k).select("query", "score").toLocalIterator():  # a row for each query
            floor[query] = score
        rest = visited(index.filter(~early), queries, k, floor, visit_bytes)
        return write_table(best(begun.drop("rank").unionByName(rest), k), "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


NAME = "op13_lexical_search"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY 1),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY 1),
i AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
