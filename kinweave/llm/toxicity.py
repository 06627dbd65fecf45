"""Toxicity by a factorization machine over hashed terms.

A text is its set of distinct terms: ASCII-lower-cased letter runs and their first 4, 5 and 6 bytes, hashed.
The machine scores ``w0 + sum w_i + (|sum v_i|^2 - sum |v_i|^2) / (2 n)`` for a text of ``n`` terms: beside the weight of each term
it learns, through low-dimensional vectors, how terms act together, such as an insult next to the
mention of a group, which single weights cannot tell. It is fitted by AdaGrad in numpy on a bounded,
class-balanced sample of labelled rows, on every term in ``least`` or more rows learned from. Noise is
held down by shrinkage: a weight's L1 penalty is ``shrink`` and falls with the evidence for its term alone,
vectors have an L2 penalty. Weights and vectors are trained together from the start, and a second part of the
sample chooses the epoch. Scores are calibrated, at the labelled rows' own share of toxic ones, on a third part
that neither step sees.

Texts are read whole, whatever their length. Null or empty texts have no term and get the calibrated base score. Repeated rows get equal scores; a
null id stays null. With no labels, or labels of one class, every score is 0. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.llm.labelled import platt, sample, sigmoid

BITS, FACTORS, STEMS = 20, 8, (4, 5, 6)
SCHEMA = "doc_id long, score double"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class Machine:
    base: float
    weight: np.ndarray
    vectors: np.ndarray
    slope: float
    offset: float


def terms(text: tb.Text) -> tuple[np.ndarray, np.ndarray]:
    """(term, edges): distinct hashed terms of each document, ascending."""
    starts, ends = text.runs(_LETTER[text.raw])
    owner = np.searchsorted(text.off, starts, side="right") - 1
    keys = [(owner << BITS) + (text.hashes(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        stem = tb.mix(text.hashes(starts[longer], starts[longer] + size) + np.uint64(1)) >> np.uint64(64 - BITS)
        keys.append((owner[longer] << BITS) + stem.astype(np.int64))
    key = np.unique(np.concatenate(keys)) if len(starts) else np.zeros(0, np.int64)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(text.n + 1) << BITS)


def logits(m: Machine, term: np.ndarray, edges: np.ndarray) -> np.ndarray:
    v = m.vectors[term]
    total = np.stack([tb.per_doc(v[:, f].astype(np.float64), edges) for f in range(v.shape[1])], 1)
    square = tb.per_doc((v * v).sum(1).astype(np.float64), edges)
    return m.base + tb.per_doc(m.weight[term].astype(np.float64), edges) + 0.5 * ((total**2).sum(1) - square) / np.maximum(np.diff(edges), 1)


def _evidence(term: np.ndarray, owner: np.ndarray, toxic: np.ndarray, clean: np.ndarray, size: int) -> np.ndarray:
    """Standard errors between each term's shares of toxic and of clean rows."""
    one, two = (np.bincount(term[x[owner]], minlength=size) / max(x.sum(), 1) for x in (toxic, clean))
    both = (one + two) / 2
    error = np.sqrt(both * (1 - both) * (1 / max(toxic.sum(), 1) + 1 / max(clean.sum(), 1)))
    return np.abs(one - two) / np.maximum(error, 1e-9)


def _learn(term: np.ndarray, edges: np.ndarray, y: np.ndarray, train: np.ndarray, stop: np.ndarray, penalty: np.ndarray, epochs: int, patience: int, rate: float, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(base, weight, vectors) of the epoch with the least loss on ``stop``, all of them trained together from the start; ends after ``patience``
    epochs without a lower loss."""
    size, r = len(penalty), np.random.default_rng(seed)
    base, w, v = 0.0, np.zeros(size, np.float32), r.normal(0, 0.1, (size, FACTORS)).astype(np.float32)
    seen_w, seen_v, seen_0 = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    penalty = penalty.astype(np.float32)
    train, stop = (x[edges[x + 1] > edges[x]] for x in (train, stop))
    best, waited = (np.inf, base, w, v), 0
    if not len(train) or not len(stop):
        return best[1:]

    def of(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = edges[pick + 1] - edges[pick]
        first = np.cumsum(count) - count
        return term[np.arange(count.sum()) - np.repeat(first - edges[pick], count)], first, np.repeat(np.arange(len(pick)), count)

    def score(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = v[ids]
        total = np.add.reduceat(own, first, axis=0)
        pairs = ((total**2).sum(1) - np.add.reduceat((own * own).sum(1), first)) / np.diff(np.append(first, len(ids)))
        return base + np.add.reduceat(w[ids], first) + 0.5 * pairs, total, own

    for _ in range(epochs):
        order = r.permutation(train)
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            ids, first, row = of(pick)
            z, total, own = score(ids, first)
            error = ((sigmoid(z) - y[pick]) / len(pick)).astype(np.float32)
            by_term = np.argsort(ids, kind="stable")
            ranked = ids[by_term]
            head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            used = ranked[head]
            gv = np.add.reduceat(((error / np.diff(np.append(first, len(ids))).astype(np.float32))[row][:, None] * (total[row] - own))[by_term], head, axis=0) + np.float32(1e-4) * v[used]
            seen_v[used] += gv**2
            v[used] -= np.float32(rate) * gv / np.sqrt(seen_v[used])
            gw = np.add.reduceat(error[row][by_term], head)
            seen_w[used] += gw**2
            step = np.float32(rate) / np.sqrt(seen_w[used])
            moved = w[used] - step * gw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty[used], 0)
            seen_0 += error.sum() ** 2
            base -= rate * float(error.sum()) / np.sqrt(seen_0)
        ids, first, _row = of(stop)
        z = score(ids, first)[0]
        loss = float(np.logaddexp(0, np.where(y[stop] > 0, -z, z)).mean())
        waited += 1
        if loss < best[0] - 1e-4:
            best, waited = (loss, base, w.copy(), v.copy()), 0
        if waited >= patience:
            break
    return best[1:]


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, per_class: int = 2500, least: int = 3, shrink: float = 0.01, epochs: int = 40, patience: int = 6, rate: float = 0.08, seed: int = 9) -> Machine:
    """Fitted on at most ``per_class`` labelled rows of each class that ``where`` selects."""
    rows = sample(docs, labels, "toxic", per_class, where)
    size = 1 << BITS
    nothing = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), 0.0, -40.0)
    y = rows["label"].to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return nothing
    known = labels.where("doc_id is not null and toxic is not null")
    known = known if where is None else known.where(where)
    share = float(known.agg(F.avg(F.col("toxic").cast("double"))).first()[0])
    parts, sizes = [], []
    for batch in tb.chunks(iter(pa.table({"text": rows["text"].combine_chunks()}).to_batches())):
        term, edges = terms(tb.Text(tb.column(batch, "text"), lower=True))
        parts.append(term)
        sizes.append(np.diff(edges))
    term = np.concatenate(parts)
    owner = np.repeat(np.arange(len(y)), np.concatenate(sizes))
    part = tb.mix(rows["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(5)
    held, stop = part == 0, part == 1
    learn = ~held & ~stop
    stop = stop if stop.any() else learn
    kept = np.bincount(term[learn[owner]], minlength=size) >= least
    owner, term = owner[kept[term]], (np.cumsum(kept) - 1)[term[kept[term]]]
    edges = np.searchsorted(owner, np.arange(len(y) + 1))
    seen = _evidence(term, owner, (y > 0) & learn, (y == 0) & learn, int(kept.sum()))
    base, weight, vectors = _learn(term, edges, y, np.flatnonzero(learn), np.flatnonzero(stop), shrink / (1 + (seen / 2) ** 4), epochs, patience, rate, seed)
    m = Machine(base, nothing.weight.copy(), nothing.vectors.copy(), 1.0, 0.0)
    m.weight[kept], m.vectors[kept] = weight, vectors
    z = logits(m, np.flatnonzero(kept)[term], edges)
    check = held if held.any() and 0 < y[held].mean() < 1 else ~held
    prior = np.where(y > 0, share / max(y[check].mean(), 1e-9), (1 - share) / max(1 - y[check].mean(), 1e-9))
    slope, offset = platt(z[check], y[check], prior[check])
    return Machine(base, m.weight, m.vectors, slope, offset)


def rate(machine):
    """Arrow batches of (doc_id, text) to scores; ``machine`` is a broadcast of a ``Machine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in tb.chunks(batches):
            score = sigmoid(m.slope * logits(m, *terms(tb.Text(tb.column(batch, "text"), lower=True))) + m.offset)
            yield pa.RecordBatch.from_pydict({"doc_id": tb.column(batch, "doc_id"), "score": pa.array(score)})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, where: Column | None = None, **fitting) -> DataFrame:
    """(doc_id, score) of every document, learned from the labels that ``where`` selects."""
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, where, **fitting))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rate(machine), SCHEMA)
