"""Bounded, repeatable samples of labelled rows for fitting a model on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a model is fitted on at most.
TEXT_BYTES = 96 << 20


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def texts_of(docs: DataFrame, ids: DataFrame, most_bytes: int = TEXT_BYTES, seed: int = 7) -> pa.Table:
    """(doc_id, text) of a bounded number of ``ids`` (_id), in order of ids: one text an id, and ``most_bytes`` in all.

    Of rows that repeat an id the text with the least hash stands for it. Ids are taken by their hashes until the next text would go
    beyond ``most_bytes``; sizes are known before any text is gathered. A null text is an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(ids.select("_id").distinct()), F.col("doc_id") == F.col("_id"))
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))).alias("one"))
    sizes = sizes.select("doc_id", "one.hash", "one.size", F.xxhash64("doc_id", F.lit(seed)).alias("turn")).collect()  # three numbers an id
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["turn"], r["doc_id"])):
        if total + r["size"] > most_bytes:
            break
        taken.append((r["doc_id"], r["hash"]))
        total += r["size"]
    picked = docs.sparkSession.createDataFrame(taken, "_id long, _hash long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    one = rows.where(F.xxhash64("text") == F.col("_hash")).groupBy("doc_id").agg(F.min("text").alias("text"))
    return one.toArrow().sort_by([("doc_id", "ascending")])


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None, seed: int = 7, most_bytes: int = TEXT_BYTES) -> pa.Table:
    """(doc_id, text, label): at most ``per_class`` labelled documents of each class, by a hash of their ids, and ``most_bytes`` of text.

    Ids are chosen from the narrow label table first, at most ``2 * per_class`` of them; of rows that repeat an id one is
    learned from. An id labelled twice takes its larger label; null labels are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known if where is None else known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    picks = [known.where(F.col("label") == k).orderBy("_h", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = {r["doc_id"]: r["label"] for r in picks[0].unionByName(picks[1]).select("doc_id", "label").collect()}
    got = texts_of(docs, docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id long"), most_bytes, seed)
    return got.append_column("label", pa.array([chosen[i] for i in got["doc_id"].to_pylist()], pa.int32()))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that calibrate scores to probabilities (Newton steps, smoothed targets)."""
    if len(z) == 0 or y.min(initial=1) == y.max(initial=0):
        return 1.0, 0.0
    w = np.ones(len(z)) if weight is None else weight
    pos, neg = (w * y).sum(), (w * (1 - y)).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(z)), 1e-6)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ beta)
        grad = x.T @ (w * (p - target)) + 1e-3 * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(curve, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])
