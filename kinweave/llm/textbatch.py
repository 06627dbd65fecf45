"""Vectorised views of Arrow text columns: byte buffers, word and line boundaries, position-free hashes.

Everything works on UTF-8 bytes. A *chunk* is a run of whole documents of a few MB; each function is
linear in its bytes apart from sorts, and no state is kept between chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _POWERS.update(up=np.cumprod(up), down=np.cumprod(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts and joins batches so that each holds about ``limit`` bytes of whole documents."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        bytes_ = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(bytes_)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= limit or at < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def beside(run, decide):
    """An Arrow function over whole rows: ``run`` sees (doc_id, text) of each chunk, and ``decide`` turns the
    chunk and what ``run`` made of it, row by row in the same order, into the rows that go on."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = pa.Table.from_batches(list(run(iter([batch.select(["doc_id", "text"])]))))
            yield decide(batch, made.combine_chunks().to_batches()[0])

    return go


def per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive edges (wraps for unsigned 64-bit)."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else (np.float64 if values.dtype.kind == "f" else np.int64))
    np.cumsum(values, out=total[1:], dtype=total.dtype)
    return total[edges[1:]] - total[edges[:-1]]


class Text:
    """One chunk: bytes, document offsets and prefix hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, self.off = buffer(texts)
        self.raw = LOWER[raw] if lower else raw
        self.n = len(self.off) - 1
        self._prefix = None

    def _first(self) -> np.ndarray:
        first = np.zeros(len(self.raw) + 1, bool)
        first[self.off] = True
        return first

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of maximal runs of True bytes that stay within one document."""
        first = self._first()
        before = np.concatenate(([False], member[:-1])) if len(member) else member
        after = np.concatenate((member[1:], [False])) if len(member) else member
        starts = np.flatnonzero(member & (~before | first[:-1]))
        ends = np.flatnonzero(member & (~after | first[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.raw])

    def edges(self, starts: np.ndarray) -> np.ndarray:
        """Where each document's items begin among items sorted by start."""
        return np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range that depends on its content alone."""
        up, down = _powers(len(self.raw) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(BYTE[self.raw] * up[: len(self.raw)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the \\n-split lines of all documents, empty ones included."""
        breaks = np.flatnonzero(self.raw == 10)
        starts = np.concatenate((self.off[:-1], breaks + 1))
        ends = np.concatenate((breaks, self.off[1:]))
        # an empty document shares its offset with its neighbour; sorting by end keeps each with its own line
        order = np.argsort(starts, kind="stable")
        return starts[order], np.sort(ends, kind="stable")


def windows(word_hash: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``width`` words inside one document."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    step = np.uint64(1)
    for j in range(width):
        total += word_hash[j : j + n] * step
        step = np.uint64((int(step) * _BASE) & ((1 << 64) - 1))
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    keep = doc[:n] == doc[width - 1 :]
    return mix(total[keep]), doc[:n][keep]


def shingle_sets(text: Text, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the distinct shingles of each document, ascending; fewer words than ``width`` make one."""
    starts, ends = text.words()
    edges = text.edges(starts)
    hashed = text.hashes(starts, ends)
    shingle, doc = windows(hashed, edges, width)
    counts = np.diff(edges)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        step = np.array([pow(_BASE, j, 1 << 64) for j in range(width)], np.uint64)
        place = np.arange(len(hashed)) - np.repeat(edges[:-1], counts)
        whole = per_doc(hashed * step[np.minimum(place, width - 1)], edges)[short]
        whole = mix(whole + counts[short].astype(np.uint64))
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        shingle, doc = np.concatenate((shingle, whole))[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(text.n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            shingle[a:b].sort()
    if len(shingle):
        fresh = np.ones(len(shingle), bool)
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
        shingle, doc = shingle[fresh], doc[fresh]
    return shingle, np.searchsorted(doc, np.arange(text.n + 1))
