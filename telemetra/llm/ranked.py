"""Ranked lexical search by a dual tree over queries and documents.

A document's value for a term is weight * ((10^9 * tf) div (1000 * tf + 12 * m)), a score the sum
of the values of a query's terms, repeats included: a product of two vectors without negative
entries.  So the product of the coordinate maxima of some queries and of some documents is
never below any of their scores.

1. Vectors.  Queries are taken in blocks of bounded size; a block's terms are what a task
   holds.  All documents are read whole: their number of terms, and the frequencies of the
   block's terms, go to a staged table, from which N, L and df are summed.
2. Trees.  The queries of a block are halved by likeness down to ``ITEM_LEAF``.  A task lays out
   a block of documents by the query node each matches best, and takes maxima over ``DOC_LEAF``
   documents and then over pairs of nodes.
3. Search.  Pairs of nodes go down from both roots.  A pair ends where its bound is below the
   weakest k-th score of its queries, so it drops all documents of one node for all queries of
   the other at once; pairs of leaves are scored.  Bounds and scores are whole numbers below
   2^53, exact in floating point.
4. A first search of 1 in ``SEED_SHARE`` documents gives k-th scores that any task may start
   from, as no k-th score of all documents is lower.  Tasks return k rows a query at most, which are
   ranked by salted partial ranks and then once more.

Equal scores rank by ascending doc_id, null first; a bound equal to the k-th score is
not pruned.  Null texts and texts without terms score nothing and are not counted in N.  A null or
repeated item_id is a query of its own; rows that share a doc_id are ranked each by itself.
Other columns play no part.  Without documents or items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.llm import arrays
from telemetra.llm.common import NO_ID, stage
from telemetra.session import ship_package

#: What one block of queries holds at most, unless a single query is longer.
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 14
ITEM_LEAF, DOC_LEAF = 4, 8
#: Entries of the maxima a task holds for one block of documents.
BLOCK_CELLS = 1 << 21
#: Query nodes by which documents are laid out, and leaves scored between looks at the k-th score.
LAYOUT_NODES, SCORED = 16, 32
SEED_SHARE = 32
SALTS = 16


def item_terms(texts: list[str | None]) -> list[list[bytes]]:
    """The terms of each text, repeats included."""
    words = _words(pa.array(texts, pa.string()))
    spelled = words.as_arrow().to_pylist()
    return [spelled[a:b] for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]


def _words(texts: pa.Array) -> arrays.Words:
    data, at = arrays.flat(texts)
    return arrays.Words(arrays.LOWER[data], at, arrays.ALNUM)


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """(item_id, terms) of all queries that have a term, in blocks; the driver holds one."""
    block: list[tuple] = []
    held = 0
    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        terms = item_terms([row["text"]])[0]
        if not terms:
            continue
        if block and (len(block) == BLOCK_ITEMS or held + len(terms) > BLOCK_TERMS):
            yield block
            block, held = [], 0
        block.append((row["item"], terms))
        held += len(terms)
    if block:
        yield block


@dataclass
class Queries:
    """A block of queries: their terms, and a tree of coordinate maxima over them."""

    terms: list[bytes]
    counts: np.ndarray  # query x term
    nodes: list[np.ndarray] = field(default_factory=list)  # queries of each node, root first
    children: list[tuple[int, int] | None] = field(default_factory=list)

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Queries:
        terms = sorted({t for text in texts for t in text})
        number = {t: i for i, t in enumerate(terms)}
        counts = np.zeros((len(texts), len(terms)))
        for i, text in enumerate(texts):
            np.add.at(counts[i], [number[t] for t in text], 1)
        made = cls(terms, counts)
        made._grow(np.arange(len(texts)))
        return made

    def _grow(self, own: np.ndarray) -> int:
        """Halve the queries by which of two unlike ones they resemble more."""
        at = len(self.nodes)
        self.nodes.append(own)
        self.children.append(None)
        if len(own) > ITEM_LEAF:
            held = self.counts[own] > 0
            one = held[int(held.sum(1).argmax())]
            other = held[int((held @ one).argmin())]
            pull = held.astype(np.int64) @ one.astype(np.int64) - held.astype(np.int64) @ other.astype(np.int64)
            order = np.argsort(-pull, kind="stable")
            half = len(own) // 2
            self.children[at] = (self._grow(own[order[:half]]), self._grow(own[order[half:]]))
        return at

    def node(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries of a node, the terms any of them has, and the coordinate maxima of these."""
        own = self.nodes[at]
        top = self.counts[own].max(0)
        columns = np.flatnonzero(top)
        return own, columns, top[columns]

    def cut(self, n: int) -> list[np.ndarray]:
        """At most ``n`` nodes that together have all queries, the largest split first."""
        chosen = [0]
        while len(chosen) < n:
            at = max(chosen, key=lambda i: len(self.nodes[i]) * (self.children[i] is not None))
            if self.children[at] is None:
                break
            chosen.remove(at)
            chosen += self.children[at]
        return [self.nodes[i] for i in chosen]


_VECTOR = "_doc long, n long, terms array<int>, times array<int>"


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(_doc, n, terms, times): all terms of each text counted, those of the block with frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.large_binary())
        for part in arrays.slices(batches, "text"):
            words = _words(part.column("text"))
            coded = words.as_arrow().dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, wanted), -1)
            term = number.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
            hit = np.flatnonzero(term >= 0)
            row = arrays.owners(words.rows)[hit]
            pair, times = np.unique(row * len(terms) + term[hit], return_counts=True)
            at = np.searchsorted(pair // len(terms), np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32)))
                for v in (pair % len(terms), times)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("_doc"), pa.array(words.counts()), *lists],
                ["_doc", "n", "terms", "times"],
            )

    return docs.mapInArrow(run, _VECTOR)


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the block; one row a term from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            held = pc.list_flatten(batch.column("terms")).to_numpy()
            total += np.bincount(held, minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    counted = found.select("terms").mapInArrow(run, "term long, df long")
    out = np.zeros(n_terms, np.int64)
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


@dataclass
class Search:
    """What a task needs for one block of queries."""

    queries: Queries
    weight: np.ndarray
    n_docs: int
    n_terms: int
    k: int
    floor: np.ndarray  # no k-th score is lower

    def values(self, n: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        m = 75 + (25 * n * self.n_docs) // max(self.n_terms, 1)
        return self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m))


class _Best:
    """The k best (score, doc) of each query so far."""

    def __init__(self, search: Search):
        n = len(search.queries.counts)
        self.k, self.floor = search.k, search.floor.copy()
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.doc: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def add(self, query: int, doc: np.ndarray, score: np.ndarray) -> None:
        on = (score >= self.floor[query]) & (score > 0)
        if not on.any():
            return
        doc, score = np.r_[self.doc[query], doc[on]], np.r_[self.score[query], score[on]]
        order = np.lexsort((doc, -score))[: self.k]
        self.doc[query], self.score[query] = doc[order], score[order]
        if len(order) == self.k:
            self.floor[query] = max(self.floor[query], score[order[-1]])


class _Documents:
    """A block of documents as sparse vectors, laid out in leaves, with maxima over the leaves."""

    def __init__(self, search: Search, tops: np.ndarray, batch: pa.RecordBatch):
        term = pc.list_flatten(batch.column("terms")).to_numpy().astype(np.int64)
        times = pc.list_flatten(batch.column("times")).to_numpy().astype(np.int64)
        size = pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64)
        doc = batch.column("_doc").to_numpy()
        n = np.repeat(batch.column("n").to_numpy(), size)
        value = search.values(n, term, times).astype(np.float64)
        row = np.repeat(np.arange(len(doc)), size)
        # the query node of one level that bounds a document highest, and how high
        bound = np.stack([np.bincount(row, value * top[term], len(doc)) for top in tops])
        order = np.lexsort((-bound.max(0), bound.argmax(0)))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        self.doc = doc[order]
        by = np.argsort(place[row], kind="stable")
        self.term, self.value = term[by], value[by]
        self.at = np.r_[0, np.cumsum(size[order])]
        self.width = len(search.weight)
        leaves = -(-len(doc) // DOC_LEAF)
        least = np.zeros((leaves, self.width))
        np.maximum.at(least, (place[row[by]] // DOC_LEAF, self.term), self.value)
        self.levels = [least]  # level i: nodes of 2^i leaves
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.concatenate([low, np.zeros((1, self.width))])
            self.levels.append(np.maximum(low[::2], low[1::2]))

    def entries(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents of some leaves, and (document, place of the entry) of all their entries."""
        low = leaves * DOC_LEAF
        own = (low[:, None] + np.arange(DOC_LEAF)).reshape(-1)
        own = own[own < len(self.doc)]
        size = self.at[own + 1] - self.at[own]
        first = np.repeat(self.at[own] - (np.cumsum(size) - size), size)
        return own, np.repeat(np.arange(len(own)), size), first + np.arange(size.sum())


class _Descent:
    """Goes down both trees with the documents of one block."""

    def __init__(self, search: Search, docs: _Documents, best: _Best):
        self.queries, self.docs, self.best = search.queries, docs, best

    def visit(self, node: int, level: int, front: np.ndarray) -> None:
        """A query node against the document nodes ``front`` of one level."""
        own, columns, top = self.queries.node(node)
        bound = self.docs.levels[level][np.ix_(front, columns)] @ top
        possible = bound >= max(self.best.floor[own].min(), 1)
        front, bound = front[possible], bound[possible]
        if not len(front):
            return
        children = self.queries.children[node]
        if not level and children is None:
            self._score(own, front, bound)
            return
        if level:
            level -= 1
            front = (2 * front[:, None] + np.arange(2)).reshape(-1)
            front = front[front < len(self.docs.levels[level])]
        for child in children or (node,):
            self.visit(child, level, front)

    def _score(self, own: np.ndarray, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Scores of the queries with the documents of the leaves, most promising first."""
        order = np.argsort(-bound, kind="stable")
        for low in range(0, len(order), SCORED):
            some = order[low : low + SCORED]
            some = some[bound[some] >= self.best.floor[own].min()]
            if not len(some):
                return
            doc, row, at = self.docs.entries(leaves[some])
            term, value = self.docs.term[at], self.docs.value[at]
            for query in own.tolist():
                score = np.bincount(row, value * self.queries.counts[query][term], len(doc))
                self.best.add(query, self.docs.doc[doc], score.astype(np.int64))


def _search(found: DataFrame, search: Search) -> DataFrame:
    """(query, _doc, score): the k best documents of each task and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = search.queries, _Best(search)
        tops = np.stack([queries.counts[own].max(0) for own in queries.cut(LAYOUT_NODES)])
        rows = max(BLOCK_CELLS // max(len(queries.terms), 1), 1) * DOC_LEAF // 2
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                docs = _Documents(search, tops, part)
                root = len(docs.levels) - 1
                _Descent(search, docs, best).visit(0, root, np.zeros(1, np.int64))
        size = [len(d) for d in best.doc]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(size)), size)),
                pa.array(np.concatenate(best.doc)),
                pa.array(np.concatenate(best.score)),
            ],
            ["query", "_doc", "score"],
        )

    return found.filter("size(terms) > 0").mapInArrow(run, "query long, _doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: of each salt first, then of those."""
    order = [F.desc("score"), F.asc("_doc")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))
    some = salted.withColumn("place", part).filter(F.col("place") <= k)
    last = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return some.withColumn("rank", last).filter(F.col("rank") <= k).drop("salt", "place")


def _block_result(spark: SparkSession, texts: DataFrame, block: list[tuple], k: int) -> DataFrame:
    queries = Queries.of([terms for _, terms in block])
    found = stage(vectors(texts, queries.terms), "vectors")
    total = found.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0
    df = document_frequencies(found, len(queries.terms))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    search = Search(queries, weight, n_docs, n_terms, k, np.zeros(len(block), np.int64))
    seed = found.filter(F.pmod(F.xxhash64("_doc", "n"), F.lit(SEED_SHARE)) == 0)
    for row in _ranked(_search(seed, search), k).filter(F.col("rank") == k).collect():
        search.floor[row["query"]] = row["score"]
    named = stage(_ranked(_search(found, search), k), "ranked")
    names = spark.createDataFrame(
        pa.table({"query": pa.array(range(len(block)), pa.int64()), "item_id": pa.array([i for i, _ in block])})
    )
    return named.join(names, "query").select(
        "item_id",
        F.col("rank").cast("int").alias("rank"),
        F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"),
        "score",
    )


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above 0 only."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), "text")
    out = None
    for block in item_blocks(items, item_id, text):
        rows = _block_result(spark, texts, block, k)
        out = rows if out is None else out.unionByName(rows)
    if out is not None:
        return out
    kind = items.schema[item_id].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
