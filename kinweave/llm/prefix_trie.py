"""Prefix tries of conversations by double arrays, one for each range of prefixes.

A turn (role, text) is a 128-bit digest, and a conversation the string of its turns' digests, so that
strings with a common prefix are neighbours in their order. Equal conversations are folded to one string
with a count before anything else. The strings are dealt to shards by ranges of that order, whatever
prefix a third of them shares, and a shard is cut again at a bound of turns, so a task never holds more.

A shard numbers its turns densely and packs its trie into BASE and CHECK arrays: the child of state ``s``
by turn ``c`` is state ``BASE[s] + c`` if ``CHECK`` names ``s`` there. All conversations walk the arrays
side by side, one turn a step, and their states add up members and least ids; sums over subtrees follow
from the deepest states up.

A node lies in several shards only if it is on the path of the first or last string of each. Those rows
are merged by the digest of their prefix: members, least id and what hangs below them in one shard only
add up, and what shared nodes have themselves (a leaf, the length of a text) is counted once, in the
shard that owns the node, and passed up along that shard's paths. Everything else is whole where it is.

Null roles and texts count as empty, turns of a conversation are in order of ``turn`` (null first; turns
that repeat a number in order of their digests), repeated rows are turns of their own. Rows without a
conv_id are ignored. Texts of any length are read whole, in digests. A conversation's digests are one row, 16 bytes a turn. An empty table
gives no nodes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.storage import Scratch

#: Turns (and conversations) of a shard, and merged nodes that a broadcast may hold (about 64 MB).
SHARD, HELD = 1 << 18, 400_000
DIGEST = 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = (
    "shared boolean, shard long, side int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, said long, distinct long, chars long, seq binary"
)
_NODES = pa.schema([(c.split()[0], {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in NODES.split(", ")])


@dataclass(frozen=True)
class DoubleArray:
    base: np.ndarray
    check: np.ndarray

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each state by each code, -1 where there is none."""
        at = self.base[state] + code
        inside = (at > 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == state), at, -1)


def packed(parent: np.ndarray, code: np.ndarray, tries: int = 16) -> DoubleArray:
    """A double array of a tree: ``parent`` of each node (node 0 is the root) and the ``code``, from 1 on, that leads to it.

    Nodes with many children take the first place that fits all of them, those with one fill what is left.
    """
    nodes = len(parent)
    child = 1 + np.argsort(parent[1:], kind="stable")
    owner, first, count = np.unique(parent[child], return_index=True, return_counts=True)  # ``child`` is in order of parents
    used = np.zeros(2 * nodes + int(code.max(initial=0)) + 2, bool)
    used[0] = True
    base, slot = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    low, end = 1, 1  # every place before ``low`` is taken, none from ``end`` on is
    for k in np.argsort(-count, kind="stable")[: np.count_nonzero(count > 1)].tolist():
        own = child[first[k] : first[k] + count[k]]
        codes = code[own]
        least, span = int(codes.min()), int(codes.max() - codes.min())
        if end + span + tries > len(used):
            used = np.append(used, np.zeros(len(used) + span, bool))
        while used[low]:
            low += 1
        places = low + np.flatnonzero(~used[low : min(end, low + 4 * tries)])[:tries]
        for place in [*places.tolist(), end]:
            if not used[place - least + codes].any():
                break
        base[owner[k]] = place - least
        slot[own] = place - least + codes
        used[slot[own]] = True
        end = max(end, place + span + 1)
    one = np.flatnonzero(count == 1)
    own = child[first[one]]
    free = np.flatnonzero(~used)
    if len(free) < len(own):
        free = np.append(free, len(used) + np.arange(len(own) - len(free)))
    slot[own] = free[: len(own)]
    base[owner[one]] = slot[own] - code[own]
    size = int(slot.max(initial=0)) + 1
    bases, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    bases[slot] = base
    check[slot[1:]] = slot[parent[1:]]
    return DoubleArray(bases, check)


def _dense(flat: np.ndarray) -> np.ndarray:
    """Numbers from 1 on for 16-byte digests."""
    high, low = flat.view(">u8").astype(np.uint64).reshape(-1, 2).T
    order = np.lexsort((low, high))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _tree(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, place of its turn in ``code``) of the distinct prefixes of strings in order; node 0 is the root."""
    size = np.diff(off)
    place = np.arange(len(code)) - np.repeat(off[:-1], size)
    before = np.repeat(np.append(0, off[:-2]), size) + place
    same = (place < np.repeat(np.append(0, size[:-1]), size)) & (code[np.minimum(before, len(code) - 1)] == code)
    shared = size.copy()  # length of the prefix that a string has in common with the one before it
    some = np.flatnonzero(size)
    if len(some):
        shared[some] = np.minimum.reduceat(np.where(same, np.repeat(size, size), place), off[:-1][some])
    made = size - shared
    node = np.concatenate(([0], np.cumsum(made)))
    parent, where = np.zeros(1 + int(made.sum()), np.int64), np.zeros(1 + int(made.sum()), np.int64)
    path = [0]
    for i, (lcp, new, at) in enumerate(zip(shared.tolist(), made.tolist(), node[:-1].tolist(), strict=True)):
        if new:
            del path[lcp + 1 :]
            parent[at + 1] = path[lcp]
            parent[at + 2 : at + 1 + new] = np.arange(at + 1, at + new)
            where[at + 1 : at + 1 + new] = np.arange(off[i] + lcp, off[i] + lcp + new)
            path.extend(range(at + 1, at + 1 + new))
    return parent, where


def _in_order(parent: np.ndarray, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Codes numbered anew by their first node in order of depth, so that children have codes close by."""
    order = 1 + np.lexsort((parent[1:], depth[1:]))
    _, first = np.unique(code[order], return_index=True)
    rank = np.zeros(int(code.max(initial=0)) + 1, np.int64)
    rank[code[order][np.sort(first)]] = np.arange(1, len(first) + 1)
    return rank


def _keys(path: bytes) -> list[bytes]:
    """A digest of each prefix of a string, from the empty one on."""
    state = hashlib.md5(usedforsecurity=False)
    out = [state.digest()]
    for at in range(0, len(path), DIGEST):
        state.update(path[at : at + DIGEST])
        out.append(state.copy().digest())
    return out


def nodes_of(shard: int, paths: list[bytes], chars: np.ndarray, conv: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
    """The nodes of one shard's strings, which are distinct and in order; ``chars`` has the length of each turn's text."""
    size = np.array([len(p) // DIGEST for p in paths], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    code = _dense(np.frombuffer(b"".join(paths), np.uint8)) if off[-1] else np.zeros(0, np.int64)
    parent, where = _tree(code, off)
    node_code = np.append(0, code[where[1:]]) if len(parent) > 1 else np.zeros(1, np.int64)
    depth = np.append(0, where[1:] - off[np.searchsorted(off, where[1:], side="right") - 1] + 1)
    rank = _in_order(parent, node_code, depth)
    code, node_code = rank[code], rank[node_code]
    array = packed(parent, node_code)

    # every string walks from the root, all of them one turn a step
    states = len(array.check)
    state, last = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
    members, ids, level = np.zeros(states, np.int64), np.full(states, np.iinfo(np.int64).max), np.full(states, -1)
    own = np.zeros(states, np.int64)
    members[0], ids[0], level[0] = n.sum(), conv.min(), 0
    live = np.arange(len(paths))
    for d in range(int(size.max(initial=0))):
        live = live[size[live] > d]
        state[live] = at = array.step(state[live], code[off[live] + d])
        np.add.at(members, at, n[live])
        np.minimum.at(ids, at, conv[live])
        level[at], own[at] = d + 1, chars[off[live] + d]
    last = state
    found = np.flatnonzero(level >= 0)
    found = found[np.argsort(level[found], kind="stable")]

    edge: dict[int, list[int]] = {}  # the states on the first and last string's path
    for side, i in ((0, 0), (1, len(paths) - 1)):
        at, edge[side] = 0, [0]
        for c in code[off[i] : off[i + 1]].tolist():
            at = int(array.step(np.array([at]), np.array([c]))[0])
            edge[side].append(at)
    shared = np.zeros(states, bool)
    shared[edge[0]] = shared[edge[1]] = True

    below = np.bincount(array.check[found[1:]], minlength=states)
    whole = ~shared & (level >= 0)
    inner = np.bincount(array.check[np.flatnonzero(whole)], minlength=states)  # children that are in this shard only
    leaves, said, distinct = (whole & (below == 0)).astype(np.int64), members * own, np.where(whole, own, 0)
    edges = np.searchsorted(level[found], np.arange(level.max() + 2))
    for d in range(int(level.max()), 0, -1):
        at = found[edges[d] : edges[d + 1]]
        for total in (leaves, said, distinct):
            np.add.at(total, array.check[at], total[at])

    ends = np.full(states, -1, np.int64)
    ends[last] = np.arange(len(paths))

    def seq(at: int) -> bytes | None:
        return hashlib.md5(paths[ends[at]], usedforsecurity=False).digest() if ends[at] >= 0 else None

    at = found[~shared[found]]
    up = array.check[at]
    keys = {s: k for side, i in ((0, 0), (1, len(paths) - 1)) for s, k in zip(edge[side], _keys(paths[i]), strict=True)}
    columns: dict[str, list] = {name: [] for name in _NODES.names}
    under = shared[up]

    def add(rows: int, **values) -> None:
        for name, kind in zip(_NODES.names, _NODES.types, strict=True):
            value = values.get(name)
            columns[name].append(pa.nulls(rows, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind))

    add(
        len(at), shared=np.zeros(len(at), bool), depth=level[at], conv_id=ids[at],
        parent_key=[keys[s] if u and s else None for s, u in zip(up.tolist(), under.tolist(), strict=True)],
        parent_conv_id=pa.array(np.where(up == 0, least, ids[up]), mask=under & (up != 0)),
        n_convs=members[at], n_children=below[at], n_leaves=leaves[at], said=said[at], distinct=distinct[at], chars=own[at], seq=[seq(s) for s in at.tolist()],
    )
    for side in (0, 1):
        at = np.array(edge[side], np.int64)
        first = np.full(len(at), not side) | ~np.isin(at, edge[0])  # what both paths have counts on the first

        def once(x: np.ndarray, at=at, first=first) -> np.ndarray:
            return np.where(first, x[at], 0)

        own_keys = [keys[s] for s in edge[side]]
        add(
            len(at), shared=np.ones(len(at), bool), shard=np.full(len(at), shard), side=np.full(len(at), side), depth=level[at], key=own_keys, parent_key=[None, *own_keys[:-1]],
            conv_id=ids[at], n_convs=once(members), n_children=once(inner), n_leaves=once(leaves), said=once(said), distinct=once(distinct), chars=own[at], seq=[seq(s) for s in edge[side]],
        )
    return pa.RecordBatch.from_arrays([pa.concat_arrays(columns[name]) for name in _NODES.names], schema=_NODES)


def tries(bound: int, least: int):
    """Nodes of a partition of strings in order, cut into shards of about ``bound`` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, weight = TaskContext.get().partitionId() << 24, [], 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table["chars"].combine_chunks()
            return nodes_of(number, table["path"].to_pylist(), lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64), table["conv_id"].to_numpy(), table["n"].to_numpy(), least)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ends = np.cumsum(np.diff(batch.column("chars").slice(at).offsets.to_numpy()) + 1)
                to = at + max(1, int(np.searchsorted(ends, bound - weight)))
                to = min(to, batch.num_rows)
                held.append(batch.slice(at, to - at))
                weight += int(ends[to - at - 1])
                at = to
                if weight >= bound:
                    yield made()
                    number, held, weight = number + 1, [], 0
        if held:
            yield made()

    return run


def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each ``seq``, from rows in order of (seq, conv_id); only a running hash is held."""
    now, state, done = None, None, ([], [])
    for batch in batches:
        seqs, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        cut = [0, *(i for i in range(1, len(seqs)) if seqs[i] != seqs[i - 1]), len(seqs)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            text = ",".join(map(str, ids[a:b])).encode()
            if seqs[a] == now:
                state.update(b"," + text)
                continue
            if now is not None:
                done[0].append(now)
                done[1].append(state.hexdigest())
            now, state = seqs[a], hashlib.sha256(text)
        if len(done[0]) >= 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["seq", "ends_sha256"])
            done = ([], [])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*done[0], now], pa.binary()), pa.array([*done[1], state.hexdigest()], pa.string())], ["seq", "ends_sha256"])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each a digest in hex and the length of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).alias("chars"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """``turns`` in which conversation c begins with the first h = crc32(c) % (``most`` + 1) turns of conversation c - c % ``every``
    in place of its own first h."""
    opening = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(opening, "_base", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("_opening", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``turns``: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    scratch = Scratch(conversations.sparkSession)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = scratch.keep(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "paths")
    size = paths.agg(F.sum(F.size("chars") + 1).alias("turns"), F.min("conv_id").alias("least")).first()
    folded = paths.groupBy("path", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    ranged = folded.repartitionByRange(max(1, -(-(size["turns"] or 0) // shard)), "path").sortWithinPartitions("path")
    nodes = scratch.keep(ranged.mapInArrow(tries(shard, size["least"] or 0), NODES), "nodes")
    seal = paths.select(F.unhex(F.md5("path")).alias("seq"), "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id")
    seal = seal.mapInArrow(sealed, "seq binary, ends_sha256 string")

    parts = nodes.where("shared")
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "said", "distinct")]
    most = [F.max(c).alias(c) for c in ("depth", "parent_key", "chars", "seq")]
    merged = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min(F.struct("shard", "side")).alias("owner"), *total, *most)
    merged = scratch.keep(merged, "merged")
    joint = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("joint"))
    merged = merged.join(joint, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("joint", F.lit(0)))
    merged = scratch.keep(merged.drop("joint"), "counted")
    owned = parts.select("key", "shard", "side", "depth").join(merged.select("key", "owner", "chars", (F.col("n_children") == 0).cast("long").alias("leaf")), "key")
    mine = F.col("owner") == F.struct("shard", "side")
    up = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    passed = owned.select("key", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(up).alias(c) for c in ("leaf", "chars")))
    passed = passed.groupBy("key").agg(F.sum("leaf").alias("more_leaves"), F.sum("chars").alias("more_chars"))
    joined = merged.join(passed, "key").join(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left")
    top = joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("said") - F.col("distinct") - F.col("more_chars")).alias("saved_tokens"), "seq")

    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("said") - F.col("distinct")).alias("saved_tokens"), "seq"]
    inner = nodes.where("not shared")
    upper = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    upper = F.broadcast(upper) if merged.limit(HELD + 1).count() <= HELD else upper
    under = inner.where("parent_key is not null").join(upper, "parent_key").withColumn("parent_conv_id", F.col("_up"))
    rows = inner.where("parent_key is null").select(*kept).unionByName(under.select(*kept)).unionByName(top)
    ended = rows.where("seq is not null").join(seal, "seq", "left")
    rows = ended.drop("seq").unionByName(rows.where("seq is null").drop("seq").withColumn("ends_sha256", F.lit(EMPTY)))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
