"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees (SRS).

Gaussian projections of length ``m`` keep distances in this sense: for vectors at distance ``d`` the
squared projected distance over ``d^2`` is chi-square with ``m`` degrees of freedom. A query walks
its projected neighbours in growing order, verifies each on the original vectors, and stops once an
unseen vector nearer than its present ``k``-th best would have had so large a projected distance only
with probability ``1 - sure``: each true neighbour is found with probability ``sure`` or more, and no
count of verified candidates is fixed.

Spark holds the tree: the top levels of the kd-tree (splits fitted on a bounded sample of projections)
are cells. Every vector is indexed in its cell, and cells are cut into blocks of bounded size. Each
query first searches its own block, which bounds its ``k``-th distance; it then goes on in rounds, to the blocks with the
nearest projected boxes first, each round with the bound of the last, until the stopping test rules out
the next block and so all later ones. A round is a join by block that neither broadcasts nor gathers the vectors. Inside a block an array kd-tree yields projected
neighbours in growing leaf distance.

Equal vectors are folded before indexing (a vector counts once, with the ``k + 1`` least ids of its
copies), so copies of one vector load no task. Vectors that are null, zero, of another length than
the commonest, or hold null or non-finite components take no part. Ties go to the smaller vec_id.
Queries with no candidates give no rows. A vec_id that repeats counts once, with the least of its vectors in
array order. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.plans.storage import Scratch

LEAF = 32
#: Blocks that a query visits in its first round after its own; twice as many in each round after that.
VISITS = 4
HITS = "query long, rep long, distance double"


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""

    def upper(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) > 1 - p else (lo, mid)
    return hi


def projection(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


def split_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(axis, cut) of the inner nodes in heap order: medians of the widest axis."""
    groups, nodes = [points], []
    for _ in range(depth):
        below = []
        for g in groups:
            axis = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            cut = float(np.median(g[:, axis])) if len(g) else 0.0
            nodes.append((axis, cut))
            right = g[:, axis] > cut
            below += [g[~right], g[right]]
        groups = below
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axis = np.array([n[0] for n in nodes] or [0])
    cut = np.array([n[1] for n in nodes] or [0.0])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > cut[at])
    return at - ((1 << depth) - 1)


class Block:
    """Vectors of one block under an array kd-tree: rows in leaf order and the leaves' boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        order, groups = np.arange(len(ids)), []
        todo = [order]
        while todo:
            g = todo.pop()
            if len(g) <= LEAF:
                groups.append(g)
                continue
            axis = np.argmax(np.ptp(points[g], axis=0))
            g = g[np.argpartition(points[g, axis], len(g) // 2)]
            todo += [g[: len(g) // 2], g[len(g) // 2 :]]
        order = np.concatenate(groups)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.edges = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
        self.lo = np.minimum.reduceat(self.points, self.edges[:-1])
        self.hi = np.maximum.reduceat(self.points, self.edges[:-1])

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, factor: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the ``k`` nearest found, given that the k-th is at most ``bound`` (squared)."""
        gap = (np.maximum(np.maximum(self.lo - point, point - self.hi), 0) ** 2).sum(1)
        order = np.argsort(gap, kind="stable")
        ids, near = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(order):
            limit = factor * min(bound, near[k - 1] if len(near) >= k else np.inf)
            if gap[order[at]] > limit:
                break
            leaves = order[at : at + step]
            rows = np.concatenate([np.arange(self.edges[x], self.edges[x + 1]) for x in leaves[gap[leaves] <= limit]])
            rows = rows[((self.points[rows] - point) ** 2).sum(1) <= limit]
            exact = ((self.vectors[rows] - vector) ** 2).sum(1)
            ids, near = np.concatenate((ids, self.ids[rows])), np.concatenate((near, exact))
            best = np.lexsort((ids, near))[:k]
            ids, near = ids[best], near[best]
            at, step = at + step, step * 2
        return ids, near


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, projections: int = 8, sure: float = 0.98, block_rows: int = 1024, sample: int = 20_000, seed: int = 17, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others of each row whose id is divisible by ``every``.

    The cells are fitted on at most ``sample`` vectors by a hash of their ids; every vector is indexed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    repeated = scratch.keep(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if repeated.limit(1).count():  # normally there are none, and no vector moves
        once = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = scratch.keep(rows.join(repeated, "vec_id", "left_anti").unionByName(once), "once")
    reps = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min(F.when(F.col("vec_id") % every == 0, 0).otherwise(1)).alias("other"))
    reps = scratch.keep(reps.select("rep", "v", "copies", (F.col("other") == 0).alias("asks")), "reps")
    total = reps.count()
    matrix = projection(dim, projections, seed)
    picked = reps.select("rep", "v").orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(sample).toArrow()
    depth = max(0, min(12, math.ceil(math.log2(max(total / block_rows, 1))), int(math.log2(max(picked.num_rows / 8, 1)))))
    nodes = split_tree(_matrix(picked["v"], dim) @ matrix, depth)
    factor = chi_square_quantile(sure, projections)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(tb.column(batch, "v"), dim) @ matrix
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(points, nodes, depth).astype(np.int32))], [*batch.schema.names, "cell"])

    placed = scratch.keep(reps.mapInArrow(place, "rep long, v array<double>, copies long, asks boolean, cell int"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("subs"))
    placed = placed.join(F.broadcast(sizes), "cell")  # at most 2^12 cells
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))

    def block_of(group: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
        v = _matrix(group["v"], dim)
        return Block(group["rep"].to_numpy(), v, v @ matrix), v, v @ matrix

    def at_home(group: pa.Table) -> pa.Table:
        """Each query's nearest in its own block, and the block's box (query -1, then its bounds)."""
        block, v, p = block_of(group)
        asks = np.flatnonzero(group["asks"].to_numpy(zero_copy_only=False))
        found = [block.search(v[i], p[i], k + 1, factor, np.inf) for i in asks]
        n = len(asks)
        return pa.table(
            {
                "query": pa.array([*group["rep"].to_numpy()[asks], -1], pa.int64()),
                "cell": pa.array([group["cell"][0].as_py()] * (n + 1), pa.int32()),
                "sub": pa.array([group["sub"][0].as_py()] * (n + 1), pa.int32()),
                "v": pa.array([*v[asks].tolist(), []], pa.list_(pa.float64())),
                "ids": pa.array([*(x.tolist() for x, _ in found), []], pa.list_(pa.int64())),
                "near": pa.array([*(x.tolist() for _, x in found), np.concatenate((block.lo.min(0), block.hi.max(0))).tolist()], pa.list_(pa.float64())),
            }
        )

    home = placed.groupBy("cell", "sub").applyInArrow(at_home, "query long, cell int, sub int, v array<double>, ids array<long>, near array<double>")
    home = scratch.keep(home, "home")
    bounds = [F.min(F.col("near")[i]).alias(f"b{i}") for i in range(projections)] + [F.max(F.col("near")[i]).alias(f"b{i}") for i in range(projections, 2 * projections)]
    boxes = home.where("query = -1").groupBy("cell").agg(*bounds, F.max("sub").alias("last")).orderBy("cell").collect()
    lo, hi = (np.array([[r[f"b{i + o}"] for i in range(projections)] for r in boxes]) for o in (0, projections))
    cells, last = np.array([r["cell"] for r in boxes]), np.array([r["last"] for r in boxes])

    blocks = np.repeat(np.arange(len(cells)), last + 1)  # of each block its cell's place, then its number in the cell
    number = np.arange(len(blocks)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)

    def onward(width: int):
        """The next ``width`` blocks of each query, by the distance of their boxes, as far as the stopping test leaves any."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in (big.slice(at, 64) for at in range(0, big.num_rows, 64)):
                    p = _matrix(tb.column(batch, "v"), dim) @ matrix
                    bound, start = tb.column(batch, "bound").to_numpy(), tb.column(batch, "start").to_numpy()
                    gap = sum(np.maximum(np.maximum(lo[:, i] - p[:, i, None], p[:, i, None] - hi[:, i]), 0) ** 2 for i in range(projections))[:, blocks]
                    own = [tb.column(batch, c).to_numpy() for c in ("cell", "sub")]
                    gap[(cells[blocks] == own[0][:, None]) & (number == own[1][:, None])] = np.inf  # its own block is done
                    order = np.argsort(gap, axis=1, kind="stable")
                    near = np.take_along_axis(gap, order, 1)
                    turn = np.arange(len(blocks))
                    left = (near <= factor * bound[:, None]) & (near < np.inf) & (turn >= start[:, None]) & (turn < start[:, None] + width)
                    q, at = np.nonzero(left)
                    x, row = order[q, at], pa.array(q)
                    fields = [tb.column(batch, "query").take(row), pa.array(cells[blocks[x]].astype(np.int32)), pa.array(number[x].astype(np.int32)), tb.column(batch, "v").take(row), pa.array(bound[q])]
                    yield pa.RecordBatch.from_arrays(fields, ["query", "cell", "sub", "v", "bound"])

        return run

    def visit(asking: pa.Table, offering: pa.Table) -> pa.Table:
        q, ids, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asking.num_rows and offering.num_rows:
            block, _, _ = block_of(offering)
            v = _matrix(asking["v"], dim)
            for i, (query, bound) in enumerate(zip(asking["query"].to_pylist(), asking["bound"].to_pylist(), strict=True)):
                x, d = block.search(v[i], v[i] @ matrix, k + 1, factor, bound)
                q.append(np.full(len(x), query))
                ids.append(x)
                near.append(d)
        return pa.table({"query": np.concatenate(q), "rep": np.concatenate(ids), "distance": np.sqrt(np.concatenate(near))})

    asked = home.where("query >= 0")
    hits = asked.select("query", F.explode(F.arrays_zip("ids", "near")).alias("h")).select("query", F.col("h.ids").alias("rep"), F.sqrt("h.near").alias("distance"))
    hits = scratch.keep(hits, "hits")
    infinite = F.lit(float("inf"))
    open_ = asked.select("query", "cell", "sub", "v", F.coalesce(F.get("near", F.lit(k)), infinite).alias("bound"), F.lit(0).cast("long").alias("start"))
    best = Window.partitionBy("query").orderBy("distance", "rep")
    key, width = ["cell", "sub", "chunk"], VISITS
    while True:
        queries = scratch.keep(open_.mapInArrow(onward(width), "query long, cell int, sub int, v array<double>, bound double"), "onward")
        # blocks that no query goes to stay where they are; one that many go to is offered once for each 4096 of them
        wanted = scratch.keep(queries.groupBy("cell", "sub").agg(F.ceil(F.count("*") / 4096).cast("int").alias("chunks")), "wanted")
        if not wanted.limit(1).count():
            break
        asking = queries.join(wanted, ["cell", "sub"]).withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).drop("chunks")
        offered = placed.select("rep", "v", "cell", "sub").join(wanted, ["cell", "sub"])
        offered = offered.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        away = asking.groupBy(key).cogroup(offered.groupBy(key)).applyInArrow(visit, HITS)
        hits = hits.unionByName(away).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
        hits = scratch.keep(hits.select("query", "rep", "distance"), "hits")
        # queries that went to as many blocks as they could go on, with the bound that they have by now
        bound = hits.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        bound = bound.select("query", F.when(F.col("n") > k, F.col("far") * F.col("far") * (1 + 1e-12)).otherwise(infinite).alias("bound"))
        more = queries.groupBy("query").count().where(F.col("count") == width).select("query")
        open_ = open_.drop("bound").join(more, "query").join(bound, "query").withColumn("start", F.col("start") + width)
        open_ = scratch.keep(open_.select("query", "cell", "sub", "v", "bound", "start"), "open")
        width *= 2

    # ids behind folded vectors: at most k + 1 of each can be among k others; only folded ones are looked up
    folded = reps.where("copies > 1").select("rep", "v")
    first = Window.partitionBy("rep").orderBy("vec_id")
    named = rows.join(folded, "v").select("rep", "vec_id")
    asks = named.where(F.col("vec_id") % every == 0).unionByName(reps.where("copies = 1 and asks").select("rep", F.col("rep").alias("vec_id")))
    few = named.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("rep", "vec_id")
    ids = few.unionByName(reps.where("copies = 1").select("rep", F.col("rep").alias("vec_id")))
    out = hits.join(ids, "rep").join(asks.select(F.col("rep").alias("query"), F.col("vec_id").alias("query_id")), "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
