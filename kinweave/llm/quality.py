"""Quality rules: exact text statistics and a calibrated hashed n-gram classifier.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows of whole texts.
The verdict on what passes them is a logistic regression over hashed word unigrams and byte 4-grams
(relative frequencies), fitted on a bounded sample of labelled rows, calibrated on a part of the
sample that the fit does not see, and compared with a fixed threshold. Both parts of a score are means
of looked-up weights, so a text is scored in one pass over its bytes, in Arrow batches.

Texts are read whole, whatever their length. Null or word-free texts have zero counts and fail the base rule. Repeated rows get equal results; a
null id stays null. With no labels, or labels of one class only, the classifier accepts all that
passes the base rules. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.llm.labelled import platt, sample, sigmoid

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Kept if the calibrated probability of good quality is at least this.
THRESHOLD = 0.5
WORDS, GRAMS, GRAM = 1 << 16, 1 << 17, 4
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # words, then byte 4-grams
    slope: float
    offset: float
    threshold: float


def _grams(text: tb.Text) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the byte 4-grams inside documents."""
    raw = text.raw.astype(np.uint32)
    if len(raw) < GRAM:
        return np.zeros(0, np.int64), np.zeros(text.n + 1, np.int64)
    code = raw[: -GRAM + 1] | (raw[1 : -GRAM + 2] << np.uint32(8)) | (raw[2 : -GRAM + 3] << np.uint32(16)) | (raw[3:] << np.uint32(24))
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 17)).astype(np.int64)
    inside = np.ones(len(raw), bool)
    for back in range(1, GRAM):
        at = text.off[1:] - back
        inside[at[at >= text.off[:-1]]] = False
    keep = np.flatnonzero(inside[: len(bucket)])
    return bucket[keep], np.searchsorted(keep, text.off)


def _features(text: tb.Text, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    words = (text.hashes(starts, ends) >> np.uint64(48)).astype(np.int64)
    grams, edges = _grams(text)
    return [(words, text.edges(starts)), (grams + WORDS, edges)]


def _logits(weights: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return weights[-1] + sum(tb.per_doc(weights[f].astype(np.float64), e) / np.maximum(np.diff(e), 1) for f, e in features)


def _table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of relative feature frequencies: (feature, value, edges)."""
    feature, value, sizes = [], [], []
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for chunk in tb.chunks(iter([batch])):
        text = tb.Text(chunk.column(0))
        parts = _features(text, *text.words())
        for d in range(text.n):
            size = 0
            for f, e in parts:
                ids, counts = np.unique(f[e[d] : e[d + 1]], return_counts=True)
                feature.append(ids.astype(np.int32))
                value.append((counts / max(counts.sum(), 1)).astype(np.float32))
                size += len(ids)
            sizes.append(size)
    return np.concatenate(feature), np.concatenate(value), np.concatenate(([0], np.cumsum(sizes)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = THRESHOLD, steps: int = 120, rate: float = 3.0) -> Model:
    """Fitted on at most ``per_class`` labelled rows of each class, four fifths of them for the weights."""
    rows = sample(docs, labels, "quality", per_class)
    size = WORDS + GRAMS + 1
    y = rows["label"].to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(size, np.float32), 0.0, 40.0, threshold)
    ids = rows["doc_id"].to_numpy()
    feature, value, edges = _table(rows["text"].combine_chunks())
    held = tb.mix(ids.astype(np.uint64)) % np.uint64(5) == 0
    owner = np.repeat(np.arange(len(y)), np.diff(edges))
    balance = np.where(y > 0, 0.5 / max((y[~held] > 0).sum(), 1), 0.5 / max((y[~held] == 0).sum(), 1)) * ~held
    w, slow, fast = np.zeros(size), np.zeros(size), np.zeros(size)

    def score() -> np.ndarray:
        return w[-1] + np.bincount(owner, w[feature] * value, len(y))

    for t in range(1, steps + 1):
        error = balance * (sigmoid(score()) - y)
        grad = np.bincount(feature, error[owner] * value, size) + 2e-7 * w
        grad[-1] += error.sum()
        slow, fast = 0.9 * slow + 0.1 * grad, 0.99 * fast + 0.01 * grad**2
        w -= rate * (slow / (1 - 0.9**t)) / (np.sqrt(fast / (1 - 0.99**t)) + 1e-6)
    z = score()
    check = held if held.any() and 0 < y[held].mean() < 1 else ~held
    slope, offset = platt(z[check], y[check])
    return Model(w.astype(np.float32), slope, offset, threshold)


def statistics(text: tb.Text, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    edges = text.edges(starts)
    n_words = np.diff(edges)
    points = (text.raw & 0xC0) != 0x80
    word_chars = tb.per_doc((points & ~tb.SPACE[text.raw]).astype(np.int64), text.off)
    n_symbols = tb.per_doc(SYMBOLS[text.raw].astype(np.int64), text.off)

    # line i of all lines belongs to document i - (line breaks of earlier documents)
    first, last = text.lines()
    breaks = tb.per_doc((text.raw == 10).astype(np.int64), text.off)
    owner = np.repeat(np.arange(text.n), breaks + 1)
    filled = np.concatenate(([0], np.cumsum(~tb.SPACE[text.raw])))
    worded = np.flatnonzero(filled[last] > filled[first])
    key = tb.mix(text.hashes(first[worded], last[worded]) + owner[worded].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, earliest = np.unique(key, return_index=True)
    n_dup = np.bincount(owner[worded], minlength=text.n) - np.bincount(owner[worded][earliest], minlength=text.n)

    hashed = text.hashes(starts, ends)
    window, doc = tb.windows(hashed, edges, WINDOW)
    place = np.flatnonzero(np.arange(len(hashed)) <= np.repeat(edges[1:], n_words) - WINDOW)
    key = tb.mix(window + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1] if len(ranked) else np.zeros(0, bool)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashed) + WINDOW + 1, np.int64)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[: len(hashed)] > 0
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": tb.per_doc(covered.astype(np.int64), edges)}


def judge(model):
    """Arrow batches of (doc_id, text) to counts and verdicts; ``model`` is a broadcast of a ``Model``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in tb.chunks(batches):
            text = tb.Text(tb.column(batch, "text"))
            starts, ends = text.words()
            got = statistics(text, starts, ends)
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
            p = sigmoid(m.slope * _logits(m.weights, _features(text, starts, ends)) + m.offset)
            yield pa.RecordBatch.from_pydict({"doc_id": tb.column(batch, "doc_id")} | {k: pa.array(v.astype(np.int64)) for k, v in got.items()} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= m.threshold)), "quality": pa.array(p)})

    return run


def quality(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Counts, base verdict, final verdict and calibrated probability of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(judge(model), SCHEMA)


def good_documents(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, in one pass and without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))
    return docs.mapInArrow(tb.beside(judge(model), lambda rows, found: rows.filter(tb.column(found, "kept"))), docs.schema)
