"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the distinct 5-word shingles of its ASCII-lower-cased words. Two sets with
Jaccard similarity of 0.8 or more differ in at most ``(|A| + |B|) / 9`` shingles. Sets are grouped in
size bands ``[2^j, 2^(j+1))``, and a set that could join a larger one of the next band signs there too.
A band in which linked sets differ in at most ``k`` shingles splits the shingle domain into
``k // 2 + 1`` parts and some more, and each part into three thirds. A linked pair differs in one
shingle at most in some part, and so agrees there on two of its thirds: every set has one signature for
each part and each of its three pairs of thirds, and linked sets share one.

A pair of thirds without shingles would be shared by all, and is not signed. A set of ``n`` shingles has
at least ``parts - k(n) // 2`` parts in which it may rely on a linked set to agree (``k(n)`` for its own
size). If as many parts of it have an empty pair of thirds, the set also signs with its prefix, the
``n - ceil(0.8 n) + 1`` least shingles. Of a linked pair either one set is not of this kind, and then a
signed pair of thirds is shared, or both are, and linked sets always share a shingle of their prefixes.
So no link is lost, whatever the sizes.

Equal sets are folded to one representative first. What is grouped then are signatures with two
members or more, of sets that share enough of theirs: a set that may rely on agreement in ``s`` parts without
an empty pair shares ``s`` signatures or more with each set it links with, so sets with fewer shared ones are
done. Texts that have no more in common than a passage mostly end here.

1. Each set goes to the hub with which it shares most signatures (a hub is the least member of a
   signature). A hub's sets are dealt to blocks of bounded size, the hub itself to each of them.
2. Signatures of which the components so far do not settle all members, and which no block has held
   whole, go to their hubs once more. A hub's group beyond one block is refined exactly: linked sets of a
   group share a shingle among the ``n - ceil(0.8 n) + 1`` of each that are rarest in this group, so sets
   meet again by those; only groups that are still beyond a block are compared block by block.

A block compares its sets exactly, on their shingles, and returns the links of a spanning forest: fewer
than it has sets, however many pairs link. The components are exact.

Null or word-free texts have an empty set and are linked with nothing; a one-shingle text links with
equal ones only. Texts are read whole, whatever their length. Documents without an id are ignored. Rows
that repeat an id are one document with the links of all its texts; each of them is returned with the
size of its own set. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.operators.components import connected_components
from kinweave.plans.storage import Scratch

SHINGLE = 5
NUM, DEN = 80, 100
#: Signatures that a grouping task holds, and shingles (with a constant for each set) that a block holds.
BUCKET, BLOCK, EACH = 500_000, 1 << 19, 256
#: Ids that a broadcast may hold, about 64 MB.
HELD = 2_000_000
_SIGN = np.uint64(1 << 63)
_THIRDS = ((0, 1), (0, 2), (1, 2))


def _most(n: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The size of the largest partner of a set of ``n``."""
    return n * den // num


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def parts_of_band(band: np.ndarray) -> np.ndarray:
    """How many parts a band has: an eighth more than a pair of its largest sets needs."""
    top = (np.int64(2) << band) - 1
    need = _apart(top, top) // 2 + 1
    return need + need // 8


def _prefix(n: np.ndarray) -> np.ndarray:
    return n + 1 - -(-n * NUM // DEN)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after another."""
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the size and a 128-bit hash of its set."""
    for batch in tb.chunks(batches, limit=1 << 19):
        shingle, edges = tb.shingle_sets(tb.Text(tb.column(batch, "text"), lower=True), SHINGLE)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": tb.column(batch, "doc_id"),
                "n": pa.array(np.diff(edges).astype(np.int64)),
                "h1": pa.array(_as_long(tb.per_doc(tb.mix(shingle), edges))),
                "h2": pa.array(_as_long(tb.per_doc(tb.mix(shingle ^ _SIGN), edges))),
            }
        )


def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its shingles as packed hashes, ascending."""
    for batch in tb.chunks(batches, limit=1 << 19):
        shingle, edges = tb.shingle_sets(tb.Text(tb.column(batch, "text"), lower=True), SHINGLE)
        packed = [shingle[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), pa.array(packed, pa.binary())], ["doc", "packed"])


def signatures(shingle: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document) of every set of a chunk, and how many signatures a set shares with any set it links with."""
    n = np.diff(edges)
    need = np.full(len(n), np.iinfo(np.int64).max)
    docs = np.flatnonzero(_apart(n, _most(n)) > 0)  # smaller sets link with equal ones only
    band = np.zeros(len(n), np.int64)
    band[docs] = np.floor(np.log2(n[docs])).astype(np.int64)
    band += (np.int64(2) << band) <= n  # guards against rounding of the logarithm
    out_sig, out_doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    upper = _most(n) >= (np.int64(2) << band)
    for which, step in ((docs, 0), (docs[upper[docs]], 1)):
        if not len(which):
            continue
        b, size = band[which] + step, n[which]
        parts = parts_of_band(b)
        first = np.cumsum(parts) - parts
        h = tb.mix(shingle[_spread(edges[:-1][which], size)] + np.repeat(b, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        third = ((h >> np.uint64(33)) % (np.repeat(parts, size).astype(np.uint64) * np.uint64(3))).astype(np.int64) + np.repeat(3 * first, size)
        total = int(parts.sum())
        content, count = np.zeros(3 * total, np.uint64), np.bincount(third, minlength=3 * total).reshape(-1, 3)
        np.add.at(content, third, tb.mix(h))
        content = content.reshape(-1, 3)
        owner = np.repeat(np.arange(len(which)), parts)
        place = ((b[owner] << 40) + _spread(np.zeros(len(which), np.int64), parts)).astype(np.uint64) * np.uint64(4)
        empty = np.zeros(total, bool)
        for k, (x, y) in enumerate(_THIRDS):
            filled = count[:, x] + count[:, y] > 0
            empty |= ~filled
            sig = tb.mix(tb.mix(content[:, x] + place + np.uint64(k)) + content[:, y])
            out_sig.append(sig[filled])
            out_doc.append(which[owner[filled]])
        apart = _apart(size, np.minimum(_most(size), (np.int64(2) << b) - 1))
        sure = parts - apart // 2 - np.bincount(owner, empty, len(which)).astype(np.int64)
        need[which] = np.minimum(need[which], np.maximum(sure, 1))
        own = which[sure <= 0]
        out_sig.append(tb.mix(shingle[_spread(edges[:-1][own], _prefix(n[own]))] ^ np.uint64(0xD1B54A32D192ED03)))
        out_doc.append(np.repeat(own, _prefix(n[own])))
    return np.concatenate(out_sig), np.concatenate(out_doc), need


def _runs(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, doc) in order, whether the signature has several documents, whether the row is its first."""
    order = np.argsort(sig)
    sig, doc = sig[order], doc[order]
    same = np.flatnonzero(sig[1:] == sig[:-1])
    if len(same):  # order the documents of the few signatures that have several rows
        inside = np.zeros(len(sig), bool)
        inside[same] = inside[same + 1] = True
        at = np.flatnonzero(inside)
        doc[at] = doc[at[np.lexsort((doc[at], sig[at]))]]
    if len(sig):
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc = sig[fresh], doc[fresh]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    last = np.append(first[1:], True)[: len(sig)]
    return sig, doc, ~(first & last), first


def _named(sig: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """What a signature is called outside its bucket."""
    return _as_long((sig & np.uint64((1 << 48) - 1)) + (bucket << np.uint64(48)))


def _packed(sig: np.ndarray, doc: np.ndarray) -> bytes:
    """Rows (sig, doc): 48 bits of each signature (its bucket tells the rest apart), its document's place in a list,
    and the list."""
    docs, place = np.unique(doc, return_inverse=True)
    kind = "<u2" if len(docs) <= 1 << 16 else "<u4"
    head = np.array([len(sig), len(docs)], "<u4").tobytes()
    return head + sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + place.astype(kind).tobytes() + docs.astype("<i8").tobytes()


def _unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, several = raw[:8].view("<u4").tolist()
    sig = np.zeros((n, 8), np.uint8)
    sig[:, :6] = raw[8 : 8 + 6 * n].reshape(n, 6)
    kind = np.dtype("<u2" if several <= 1 << 16 else "<u4")
    end = 8 + (6 + kind.itemsize) * n
    docs = raw[end : end + 8 * several].copy().view("<i8")
    return sig.view("<u8")[:, 0], docs[raw[8 + 6 * n : end].copy().view(kind)].astype(np.int64)


def sign(buckets: int, hold: int = 2 << 20):
    """Packed signatures by bucket. Members of a signature that has several in the chunk are complete
    findings: they ride along in whichever bucket comes next, and one of them stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for big in tb.chunks(batches, limit=hold):
            sigs, docs, needs, of = [], [], [], []
            for batch in tb.chunks(iter([big]), limit=1 << 19):
                text = tb.Text(tb.column(batch, "text"), lower=True)
                ids = tb.column(batch, "doc_id").to_numpy(zero_copy_only=False)
                sig, doc, need = signatures(*tb.shingle_sets(text, SHINGLE))
                sigs.append(sig)
                docs.append(ids[doc].astype(np.int64))
                needs.append(need)
                of.append(ids.astype(np.int64))
            sig, doc, several, first = _runs(np.concatenate(sigs), np.concatenate(docs))
            where = (sig >> np.uint64(40)) % np.uint64(buckets)
            heads = np.flatnonzero(first)
            heads = heads[np.argsort(where[heads], kind="stable")]
            cut = np.searchsorted(where[heads], np.arange(buckets + 1).astype(np.uint64))
            rows = [(k, _packed(sig[heads[a:b]], doc[heads[a:b]]), b"", b"") for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            several = np.flatnonzero(several)
            for at in range(0, len(several), 1 << 14):
                own = several[at : at + (1 << 14)]
                rows.append(((int(doc[0]) + turn) % buckets, b"", _named(sig[own], where[own]).tobytes(), doc[own].tobytes()))
                turn += 1
            rows.append(((int(of[0][0]) + turn) % buckets, b"", b"", b""))
            fields = {"bucket": pa.array([r[0] for r in rows], pa.int32())}
            for k, name in enumerate(("packed", "known_sigs", "known_docs"), 1):
                fields[name] = pa.array([r[k] for r in rows], pa.binary())
            for name, values in (("needs", needs), ("needing", of)):  # with the chunk's last row
                fields[name] = pa.array([*[b""] * (len(rows) - 1), np.concatenate(values).tobytes()], pa.binary())
            yield pa.RecordBatch.from_pydict(fields)

    return run


def meet(group: pa.Table) -> pa.Table:
    """Members of signatures that have several, some of them twice; and (no signature, doc, need) rows."""
    parts = [_unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in group["packed"] if x.as_buffer().size]
    sig, doc, several, _ = _runs(*(np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]) for k, kind in ((0, np.uint64), (1, np.int64))))
    known_sig, known_doc, need, needing = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in group[c])]) for c in ("known_sigs", "known_docs", "needs", "needing"))
    bucket = np.uint64(group["bucket"][0].as_py() if group.num_rows else 0)
    sig = np.concatenate((_named(sig[several], np.full(int(several.sum()), bucket)), known_sig))
    doc = np.concatenate((doc[several], known_doc))
    sig = pa.concat_arrays([pa.array(sig), pa.nulls(len(need), pa.int64())])
    return pa.table({"sig": sig, "doc": np.concatenate((doc, needing)), "need": pa.concat_arrays([pa.nulls(len(doc), pa.int64()), pa.array(need)])})


def forest(doc: np.ndarray, component: np.ndarray, sets: list[np.ndarray], num: int = NUM, den: int = DEN, minima: np.ndarray | None = None, agree: int = 0) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets given, on top of the components known already. With ``minima`` (a row
    of each set), sets that agree in fewer than ``agree`` of them are not compared."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    doc, size, label = doc[order], size[order], np.unique(component[order], return_inverse=True)[1]
    edges = np.concatenate(([0], np.cumsum(size)))
    _, code, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    # a set links only if enough of its shingles occur elsewhere; shingles that do not are never in an intersection
    shared = count[code] > 1
    kept = tb.per_doc(shared.astype(np.int64), edges)
    able = den * kept >= num * size
    code = code[shared & np.repeat(able, size)]
    doc, size, label, kept = doc[able], size[able], label[able], kept[able]
    minima = minima[order][able] if minima is not None else None
    edges = np.concatenate(([0], np.cumsum(kept)))
    last = np.searchsorted(size, _most(size, num, den), side="right")
    mine = np.zeros(len(count), bool)
    links = []
    for x in range(len(doc)):
        apart = np.flatnonzero(label[x + 1 : last[x]] != label[x])
        if not len(apart):
            continue
        a, b = x + 1 + apart[0], x + 2 + apart[-1]
        near = x + 1 + apart
        if minima is not None:
            near = near[(minima[near] == minima[x]).sum(1) >= agree]
            if not len(near):
                continue
            a, b = near[0], near[-1] + 1
        mine[code[edges[x] : edges[x + 1]]] = True
        if len(near) < 16:
            both = np.array([np.count_nonzero(mine[code[edges[y] : edges[y + 1]]]) for y in near])
        else:
            both = np.add.reduceat(mine[code[edges[a] : edges[b]]], edges[a:b] - edges[a], dtype=np.int64)[near - a]
        mine[code[edges[x] : edges[x + 1]]] = False
        for y in near[den * both >= num * (size[x] + size[near] - both)]:
            if label[x] != label[y]:
                links.append((int(doc[x]), int(doc[y])))
                label[label == label[y]] = label[x]
    return links


def link(num: int = NUM, den: int = DEN, agree: int | None = None):
    """Forests of the blocks of a group, each block a value of ``block``; with ``agree``, sets have minima."""

    def run(group: pa.Table) -> pa.Table:
        a, b = [], []
        if group.num_rows:
            group = group.sort_by([("block", "ascending"), ("doc", "ascending")])
            block, doc, component = (group[c].to_numpy() for c in ("block", "doc", "component"))
            packed = group["packed"].to_pylist()
            minima = np.frombuffer(b"".join(group["minima"].to_pylist()), np.uint32).reshape(len(doc), -1) if agree is not None else None
            cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if (component[i:j] != component[i]).any():
                    own = minima[i:j] if minima is not None else None
                    for x, y in forest(doc[i:j], component[i:j], [np.frombuffer(p, np.uint64) for p in packed[i:j]], num, den, own, agree or 0):
                        a.append(x)
                        b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, doc, component, n, token): a row for each shingle of the sets."""
    for batch in tb.chunks(batches, "packed"):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in tb.column(batch, "packed")]
        row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        kept = [tb.column(batch, c).take(row) for c in ("hub", "doc", "component", "n")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(sets))], ["hub", "doc", "component", "n", "token"])


class Confirmed:
    """Components of the documents that share signatures, confirmed on ``sets`` (doc, packed, n[, minima])."""

    def __init__(self, scratch: Scratch, sets: DataFrame, block: int, num: int = NUM, den: int = DEN, agree: int | None = None):
        self.scratch, self.sets, self.block = scratch, sets, block
        self.num, self.den, self.agree = num, den, agree

    def weight(self, rows: DataFrame) -> int:
        return rows.agg(F.sum(F.col("n") + EACH)).first()[0] or 0

    def dealt(self, rows: DataFrame, total: int) -> DataFrame:
        """Rows (hub, part, doc, component) with their sets, blocks dealt to groups of bounded size, to links."""
        key = F.xxhash64("hub", "part")
        rows = rows.select(key.alias("block"), F.pmod(key, F.lit(8 + 2 * total // self.block)).alias("deal"), "doc", "component")
        rows = rows.join(self.sets.drop("n"), "doc")
        return rows.groupBy("deal").applyInArrow(link(self.num, self.den, self.agree), "a long, b long")

    def blocks(self, rows: DataFrame, key: str = "hub") -> DataFrame:
        """How many blocks each hub's sets (rows with n) need."""
        return rows.groupBy(key).agg(F.ceil(F.sum(F.col("n") + EACH) / self.block).cast("int").alias("blocks"))

    def unsettled(self, members: DataFrame) -> DataFrame:
        """(hub, doc, component, n), distinct, of members (sig, doc, component, n, done) whose signature joins several
        components and is not done for one of them; of signatures with the same members one goes on."""
        seen = members.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc").alias("hub"), F.count("*").alias("size"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("all"), F.min("done").alias("done"))
        seen = seen.where("lo < hi and not done").groupBy("hub", "size", "all").agg(F.min("sig").alias("sig"))
        return members.join(seen.select("sig", "hub"), "sig").select("hub", "doc", "component", "n").distinct()

    def first_links(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of the blocks of each set's best hub; (doc, hub, whole): whether one block held all sets of the hub."""
        hubs = members.groupBy("sig").agg(F.min("doc").alias("hub"))
        support = members.join(hubs, "sig").where("doc <> hub").groupBy("doc", "hub").count()
        best = support.groupBy("doc").agg(F.max(F.struct("count", (-F.col("hub")).alias("minus"))).alias("m")).select("doc", (-F.col("m.minus")).alias("hub"))
        best = self.scratch.keep(best.join(self.sets.select("doc", "n"), "doc"), "best")
        blocks = self.blocks(best)
        rows = best.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("part"), "doc")
        rows = rows.unionByName(blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("hub").alias("doc")))
        found = self.scratch.keep(self.dealt(rows.withColumn("component", F.col("doc")), self.weight(self.sets)), "links")
        return found, best.join(blocks, "hub").select("doc", "hub", (F.col("blocks") == 1).alias("whole"))

    def more_links(self, members: DataFrame, held: DataFrame, first: DataFrame) -> DataFrame:
        """Links between the components ``first`` that members of one signature may still have."""
        known = self.sets.select("doc", "n").join(first.select(F.col("node").alias("doc"), "component"), "doc", "left")
        known = known.join(held, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"), F.col("hub").alias("best"), "whole")
        hubs = members.groupBy("sig").agg(F.min("doc").alias("least"))
        placed = members.join(hubs, "sig").join(known, "doc")
        done = (F.col("doc") == F.col("least")) | F.coalesce((F.col("best") == F.col("least")) & F.col("whole"), F.lit(False))
        rows = self.scratch.keep(self.unsettled(placed.select("sig", "doc", "component", "n", done.alias("done"))), "unsettled")
        blocks = self.scratch.keep(self.blocks(rows), "blocks")
        small = rows.join(blocks.where("blocks = 1").select("hub"), "hub").select("hub", F.lit(0).alias("part"), "doc", "component")

        dealt = small
        total = self.weight(rows)
        if blocks.where("blocks > 1").limit(1).count():
            split, more = self.refined(rows.join(blocks.where("blocks > 1").select("hub"), "hub"))
            dealt, total = small.unionByName(split), total + more
        return self.scratch.keep(self.dealt(dealt, total), "more")

    def refined(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """(hub, part, doc, component) and their weight: the sets of groups beyond one block, met again by their rarest shingles."""
        large = rows.join(self.sets.select("doc", "packed"), "doc").select("hub", "doc", "component", "n", "packed")
        spelt = large.mapInArrow(tokens, "hub long, doc long, component long, n long, token long")
        often = spelt.groupBy("hub", "token").count().where("count > 1")
        ranked = spelt.join(often, ["hub", "token"], "left").groupBy("hub", "doc", "component", "n")
        ranked = ranked.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "token"))).alias("all"))
        prefix = F.col("n") + 1 - F.ceil(F.col("n") * self.num / self.den)
        rare = ranked.select("hub", "doc", "component", "n", F.explode(F.slice("all", F.lit(1), prefix.cast("int"))).alias("t")).where("t.count > 1")
        again = rare.select(F.xxhash64("hub", "t.token").alias("sig"), "doc", "component", "n", F.lit(False).alias("done"))
        again = self.scratch.keep(self.unsettled(self.scratch.keep(again, "again")), "refined")
        sizes = self.scratch.keep(self.blocks(again), "refined-blocks")
        split = again.join(sizes, "hub").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
        weight = self.block * (sizes.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 0)
        return split.select("hub", part.cast("int").alias("part"), "doc", "component"), weight


def held(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most ``HELD``; beyond that the planner shuffles."""
    return F.broadcast(ids) if ids.limit(HELD + 1).count() <= HELD else ids


def described(texts: DataFrame, describe, kind: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(size and hash of the set of each document, representatives of equal sets: h1, h2, rep, n)."""
    sizes = scratch.keep(texts.mapInArrow(describe, kind), "sizes")
    filled = sizes.where("n > 0 and doc_id is not null")
    return sizes, scratch.keep(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "reps")


def components(join: Confirmed, sizes: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, from ``members`` (sig, doc) of signatures."""
    scratch = join.scratch
    links, held = join.first_links(members)
    first = scratch.keep(connected_components(links, "a", "b"), "first")
    more = join.more_links(members, held, first)
    # an id with several texts ties their sets together
    filled = sizes.where("n > 0 and doc_id is not null")
    several = filled.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi")
    tied = filled.join(several.select("doc_id"), "doc_id", "left_semi").join(reps, ["h1", "h2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    extra = scratch.keep(more.unionByName(tied), "extra")
    final = scratch.keep(connected_components(links.unionByName(extra), "a", "b"), "final") if extra.limit(1).count() else first

    named = reps.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = filled.join(named, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionByName(sizes.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    scratch.drop(links, more, join.sets)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; ``bucket`` and ``block`` set the memory of a task."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sizes, reps = described(texts, describe, "doc_id long, n long, h1 long, h2 long", scratch)
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    copies = sizes.where("n > 0").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id").distinct()
    chosen = texts.join(held(scratch.keep(copies, "copies")), "doc_id", "left_anti")
    signed = chosen.mapInArrow(sign(max(8, int(total) // bucket + 1)), "bucket int, packed binary, known_sigs binary, known_docs binary, needs binary, needing binary")
    met = scratch.keep(signed.groupBy("bucket").applyInArrow(meet, "sig long, doc long, need long"), "met")
    needed = met.groupBy("doc").agg(F.count("sig").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("doc")
    members = scratch.keep(met.where("sig is not null").select("sig", "doc").join(needed, "doc", "left_semi"), "members")
    needed = members.select("doc").distinct()
    needed = scratch.keep(needed.select(F.col("doc").alias("doc_id")), "needed")
    packed = texts.join(held(needed), "doc_id", "left_semi").mapInArrow(shingles, "doc long, packed binary")
    sets = scratch.keep(packed.withColumn("n", (F.octet_length("packed") / 8).cast("long")).where("n > 0"), "sets")
    out = components(Confirmed(scratch, sets, block), sizes, reps, members)
    scratch.drop(met, members)
    return out
