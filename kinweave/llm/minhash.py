"""MinHash near duplicates: documents whose sets of 3-word shingles have Jaccard similarity of 0.85 or more.

A set is signed by 150 minima of universal hash functions ``a x + b`` modulo 2^64, of which the upper halves
count. Thirty bands of five minima group the sets: a linked pair misses all bands with a chance of 2e-8 at
most. Equal sets are folded to one representative first, so a group of copies signs once.

Sets of a band are not paired with each other. Each goes to the hub (the least member of a band) with which it
shares most bands, a hub's sets are dealt to blocks of bounded size, and bands that the components so far leave
unsettled meet once more, as in the n-gram join. In a block, two sets whose signatures agree in at least 98 of
150 minima (a linked pair has fewer with a chance of about 1e-10) are confirmed on their full shingle sets, and the links of
a spanning forest are returned. Components come from alternating large-star and small-star rounds.

Words are runs of anything but ASCII white space, A-Z lower-cased; texts of fewer than three words are one shingle. Null and
word-free texts have an empty set and are linked with nothing. Texts are read whole, whatever their length.
Rows that repeat an id are one document with the links of all its texts. Documents without an id are linked with nothing
and have no component. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import ngram_join as nj
from kinweave.llm import textbatch as tb
from kinweave.plans.storage import Scratch

SHINGLE, NUM, DEN = 3, 85, 100
BANDS, ROWS, AGREE = 30, 5, 98
BLOCK = 1 << 18
#: Documents of a chunk are signed about so many bytes at a time.
BYTES = 1 << 18
_DRAWN = np.random.default_rng(2003).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
TIMES, PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def minima(shingle: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of minima for each set; those of empty sets are all ones."""
    out = np.full((BANDS * ROWS, len(edges) - 1), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        for i, (a, b) in enumerate(zip(TIMES, PLUS, strict=True)):
            out[i, some] = np.minimum.reduceat(shingle * a + b, edges[:-1][some]) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band of each signature."""
    split = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    name = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), split.shape[:2])
    for r in range(ROWS):
        name = tb.mix(name * np.uint64(0x9E3779B97F4A7C15) + split[:, :, r])
    return name.view(np.int64)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tb.shingle_sets(tb.Text(tb.column(batch, "text"), lower=True), SHINGLE)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the size and a 128-bit hash of its set, and its bands."""
    for batch in tb.chunks(batches, limit=BYTES):
        shingle, edges = _sets(batch)
        named = bands(minima(shingle, edges))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": tb.column(batch, "doc_id"),
                "n": pa.array(np.diff(edges).astype(np.int64)),
                "h1": pa.array(tb.per_doc(tb.mix(shingle), edges).view(np.int64)),
                "h2": pa.array(tb.per_doc(tb.mix(shingle ^ np.uint64(1 << 63)), edges).view(np.int64)),
                "bands": pa.ListArray.from_arrays(np.arange(0, named.size + 1, BANDS).astype(np.int32), pa.array(named.ravel())),
            }
        )


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its shingles as packed hashes, and its minima."""
    for batch in tb.chunks(batches, limit=BYTES):
        shingle, edges = _sets(batch)
        packed = [shingle[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        rows = [r.tobytes() for r in minima(shingle, edges)]
        yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), pa.array(packed, pa.binary()), pa.array(np.diff(edges)), pa.array(rows, pa.binary())], ["doc", "packed", "n", "minima"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; ``block`` sets the memory of a task."""
    scratch = Scratch(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes, reps = nj.described(every, describe, "doc_id long, n long, h1 long, h2 long, bands array<long>", scratch)
    own = sizes.where("n > 0").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = own.select(F.explode("bands").alias("sig"), F.col("doc_id").alias("doc"))
    met = rows.groupBy("sig").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("sig")
    members = scratch.keep(rows.join(met, "sig"), "members")
    needed = scratch.keep(members.select(F.col("doc").alias("doc_id")).distinct(), "needed")
    chosen = every.where("doc_id is not null").join(nj.held(needed), "doc_id", "left_semi")
    sets = scratch.keep(chosen.mapInArrow(signed, "doc long, packed binary, n long, minima binary").where("n > 0"), "sets")
    found = nj.components(nj.Confirmed(scratch, sets, block, NUM, DEN, AGREE), sizes, reps, members)
    scratch.drop(members)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
