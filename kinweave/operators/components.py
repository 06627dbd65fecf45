"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges are first contracted where they lie: each run of edges gives way to a spanning forest of itself,
nodes hanging on the least of theirs. A round is then a grouped minimum (combined before its shuffle)
and an equi-join, twice, so a hub with a third of all edges is never gathered in one place, and the
number of rounds grows with the logarithm of the longest path. A round writes one table; nothing but
two numbers of it reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.storage import Scratch

#: Edges contracted together.
RUN = 1 << 18


def least_reachable(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """The least node that each of ``nodes`` numbered nodes reaches over the edges."""
    label = np.arange(nodes)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code, rows): codes in the order of the values (structs field by field), and a row that holds each."""
    code = np.zeros(len(column), np.int64)
    for field in column.flatten() if pa.types.is_struct(column.type) else [column]:
        own = np.unique(field.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of edges (u, v) as a forest: every node but the least of its tree, with that least."""

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        names = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held])
        code, row = _numbered(names)
        label = least_reachable(code[: len(code) // 2], code[len(code) // 2 :], len(row))
        moved = np.flatnonzero(label != np.arange(len(row)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(row[x])) for x in (moved, label[moved])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= RUN:
            yield forest(held)
            held, rows = [], 0
    if held:
        yield forest(held)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    Null ends and loops are ignored, repeated edges count once, an empty table gives an empty table.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    kind = edges.schema[u].dataType
    now = edges.select(F.col(u).alias("u"), F.col(v).cast(kind).alias("v")).where("u <> v")
    now = now.mapInArrow(_forest, f"u {kind.simpleString()}, v {kind.simpleString()}")
    now = scratch.keep(now.distinct(), "edges")
    seen = _state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        # large star: neighbours above a node hang on the least of its neighbourhood
        near = _both_ways(now)
        big = near.join(_least(near), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u <> v").distinct(), "round")
        state = _state(after)
        scratch.drop(now)
        now, done, seen = after, state == seen, state
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
