"""Ranked lexical search over documents, in part term at a time and in part document at a time.

A term's weight and a document's length norm come from counts over all documents. The documents are then
searched where they are read, shard by shard (a bounded run of documents, in order of their ids): the terms
of the items get lists of postings with their share of a score, and for each item

* lists are taken from the shortest on, as long as together they hold no more postings than a quarter of the shard's
  documents, and summed up term at a time. The sums are one more iterator over documents, with a bound;
* the long lists are walked document at a time, a block of documents after another, beside that iterator. A
  block whose bounds (of the sums and of each list in it) can't reach the item's tenth score is skipped, and
  in the others a document is looked up in list after list only while its score and the bounds of the lists
  left can reach it.

A task keeps the best of each item over all of its shards, so later ones skip more, and returns those alone;
the best of all tasks follow from two grouped rankings. Nothing is pruned that could be among the best:
scores are whole numbers and equal scores are in order of ids.

Items are searched in blocks of bounded text, each of them broadcast in turn; what a task holds depends on
the block's terms and the shard. Terms are compared by 64-bit hashes of their bytes.

Null and word-free texts have no terms: such documents count nowhere and such items find nothing. Texts are
read whole. Rows that repeat an item_id are one item with the terms of all of them, and items without an id
are ignored. Rows that repeat a doc_id are documents of their own; documents without one are ranked after
others of the same score. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.plans.storage import Scratch

#: Bytes of item texts that are broadcast together; documents and text bytes of a shard; documents of a block.
ITEMS, DOCS, BYTES, BLOCK = 4 << 20, 8192, 16 << 20, 128
#: Length normalisation in hundredths, saturation in thousandths.
NORM, ONE = 75, 1_000_000_000
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

TERM = np.ones(256, bool)
TERM[:128] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    TERM[_a:_b] = True


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the terms of each text, repeats included."""
    text = tb.Text(texts, lower=True)
    starts, ends = text.runs(TERM[text.raw])
    return text.hashes(starts, ends), text.edges(starts)


@dataclass(frozen=True)
class Items:
    """A block of items: which terms (places in ``terms``, ascending hashes) each asks for, and how often."""

    ids: np.ndarray
    terms: np.ndarray
    edges: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, texts: list[str]) -> Items:
        hashed, edges = term_hashes(pa.array(texts, pa.string()))
        terms, term = np.unique(hashed, return_inverse=True)
        own, item = np.unique(ids, return_inverse=True)
        pair, times = np.unique(np.repeat(item, np.diff(edges)) * len(terms) + term, return_counts=True)
        return cls(own, terms, np.searchsorted(pair, np.arange(len(own) + 1) * len(terms)), pair % max(len(terms), 1), times)

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """The place of each hash in ``terms``, -1 for others."""
        if not len(self.terms):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
        return np.where(self.terms[at] == hashed, at, -1)


def counted(shared):
    """(term, n): in how many documents each asked term is (-1: documents with a term, -2: their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        seen, docs, length = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in tb.chunks(batches):
            hashed, edges = term_hashes(tb.column(batch, "text"))
            size = np.diff(edges)
            docs, length = docs + int((size > 0).sum()), length + len(hashed)
            at = items.places(hashed)
            doc = np.repeat(np.arange(len(size)), size)[at >= 0]
            pair = np.unique(doc * max(len(items.terms), 1) + at[at >= 0])
            seen += np.bincount(pair % max(len(items.terms), 1), minlength=len(items.terms))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(some, [-1, -2])), "n": pa.array(np.append(seen[some], [docs, length]))})

    return run


class Shard:
    """Postings of some documents, by term and then by document; documents are in order of their ids."""

    def __init__(self, postings: list[np.ndarray], ids: np.ndarray, null: np.ndarray, norm: np.ndarray, weight: np.ndarray):
        order = np.lexsort((ids, null))
        self.ids, self.null = ids[order], null[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term, doc, tf = postings
        doc = rank[doc]
        by = np.lexsort((doc, term))
        term, self.doc, tf = term[by], doc[by], tf[by]
        self.share = weight[term] * (ONE * tf // (1000 * tf + 8 * norm[order][self.doc]))
        self.edges = np.searchsorted(term, np.arange(len(weight) + 1))
        self.blocks = -(-len(ids) // BLOCK)
        self.blocked: dict[int, np.ndarray] = {}

    def bounds(self, term: int) -> np.ndarray:
        """The largest share of a term in each block of documents."""
        if term not in self.blocked:
            a, b = self.edges[term], self.edges[term + 1]
            block = self.doc[a:b] // BLOCK
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            out = np.zeros(self.blocks, np.int64)
            out[block[first]] = np.maximum.reduceat(self.share[a:b], first)
            self.blocked[term] = out
        return self.blocked[term]

    def best(self, terms: np.ndarray, times: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the ``k`` best, those of at least ``floor``."""
        size = self.edges[terms + 1] - self.edges[terms]
        order = np.argsort(size, kind="stable")[np.count_nonzero(size == 0) :]
        terms, times = terms[order], times[order]
        short = int(np.searchsorted(np.cumsum(size[order]), len(self.ids) // 4, side="right"))

        # term at a time: the sums of the short lists, and their bound in each block
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        for t, q in zip(terms[:short].tolist(), times[:short].tolist(), strict=True):
            a, b = self.edges[t], self.edges[t + 1]
            sums[self.doc[a:b]] += q * self.share[a:b]
        bound = sums.reshape(-1, BLOCK).max(1) if self.blocks else np.zeros(0, np.int64)

        # document at a time: the long lists beside the sums, the list with the largest bound first
        lists = [(q * self.bounds(t), q, t) for t, q in zip(terms[short:].tolist(), times[short:].tolist(), strict=True)]
        lists.sort(key=lambda x: -int(x[0].max()))
        left = np.zeros((len(lists) + 1, self.blocks), np.int64)  # bounds of the lists from each on
        for i in range(len(lists) - 1, -1, -1):
            left[i] = left[i + 1] + lists[i][0]
        reach = bound + left[0]
        docs, scores, at, step = [], [], 0, 2
        while True:
            open_ = at + np.flatnonzero((reach[at:] >= floor) & (reach[at:] > 0))[:step]
            if not len(open_):
                break
            at = int(open_[-1]) + 1
            step *= 2
            doc = (open_[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            doc = doc[doc < len(self.ids)]
            score = sums[doc]
            for i, (_, q, t) in enumerate(lists):
                may = score + left[i][doc // BLOCK] >= floor
                doc, score = doc[may], score[may]
                if not len(doc):
                    break
                a, b = self.edges[t], self.edges[t + 1]
                place = a + np.searchsorted(self.doc[a:b], doc)
                hit = place < b
                hit[hit] = self.doc[place[hit]] == doc[hit]
                score[hit] += q * self.share[place[hit]]
            good = (score >= floor) & (score > 0)
            docs.append(doc[good])
            scores.append(score[good])
            if sum(map(len, docs)) >= k:
                doc, score = np.concatenate(docs), np.concatenate(scores)
                kept = np.lexsort((doc, -score))[:k]
                docs, scores = [doc[kept]], [score[kept]]
                floor = max(floor, int(score[kept[-1]]))
        return (np.concatenate(docs), np.concatenate(scores)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def searched(shared, weight: np.ndarray, n: int, length: int, k: int, docs: int, bytes_: int):
    """The ``k`` best documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        top = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items.ids)  # ids, null, scores
        postings, ids, norms, read = [], [], [], 0

        def search() -> None:
            doc_id = pa.concat_arrays(ids)
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            shard = Shard([np.concatenate(x) for x in zip(*postings, strict=True)], doc_id.fill_null(0).to_numpy(), null, np.concatenate(norms), weight)
            for i, (a, b) in enumerate(zip(items.edges[:-1].tolist(), items.edges[1:].tolist(), strict=True)):
                ids_, null_, scores = top[i]
                doc, score = shard.best(items.term[a:b], items.times[a:b], int(scores[-1]) if len(scores) == k else 0, k)
                if len(doc):
                    ids_, null_, scores = np.append(ids_, shard.ids[doc]), np.append(null_, shard.null[doc]), np.append(scores, score)
                    kept = np.lexsort((ids_, null_, -scores))[:k]
                    top[i] = ids_[kept], null_[kept], scores[kept]

        for batch in tb.chunks(batches):
            hashed, edges = term_hashes(tb.column(batch, "text"))
            size = np.diff(edges)
            at = items.places(hashed)
            base = sum(map(len, norms))
            pair, tf = np.unique(np.repeat(np.arange(len(size)), size)[at >= 0] * max(len(weight), 1) + at[at >= 0], return_counts=True)
            postings.append((pair % max(len(weight), 1), base + pair // max(len(weight), 1), tf.astype(np.int64)))
            ids.append(tb.column(batch, "doc_id"))
            norms.append(100 - NORM + NORM * size * n // max(length, 1))
            read += batch.get_total_buffer_size()
            if base + batch.num_rows >= docs or read >= bytes_:
                search()
                postings, ids, norms, read = [], [], [], 0
        if ids:
            search()
        rows = [len(x[0]) for x in top]
        null = np.concatenate([np.zeros(0, bool), *(x[1] for x in top)])
        found = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in top)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items.ids, rows)), pa.array(found, mask=null), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[2] for x in top)]))], schema=_FOUND)

    return run


def _blocks(items: DataFrame, bound: int) -> Iterator[list]:
    """Items in runs of about ``bound`` bytes of text, read one partition at a time."""
    held, size = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        if size + len(row["text"]) > bound and held and held[-1]["item_id"] != row["item_id"]:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["text"])
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEMS, shard_docs: int = DOCS, shard_bytes: int = BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for rows in _blocks(asked, item_bytes):
        shared = spark.sparkContext.broadcast(Items.of(np.array([r["item_id"] for r in rows], np.int64), [r["text"] for r in rows]))
        counts = texts.select("text").mapInArrow(counted(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in counts.collect()}  # one row a term of the block
        n, length = counts.pop(-1, 0), counts.pop(-2, 0)
        seen = np.zeros(len(shared.value.terms), np.int64)
        seen[list(counts)] = list(counts.values())
        weight = np.floor(1000 * np.log((2 * n + 2) / (2 * seen + 1))).astype(np.int64)
        best = texts.mapInArrow(searched(shared, weight, n, length, k, shard_docs, shard_bytes), "item_id long, doc_id long, score long")
        found = found.unionByName(scratch.keep(best, "best"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # a task gives k rows an item, and there may be many tasks: 64 groups an item first
    few = found.withColumn("deal", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "deal").orderBy(*order))).where(F.col("r") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
