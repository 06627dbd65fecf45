"""Secret scans: pattern rules, and a character convolutional network over every candidate in context.

Base rules find credential assignments, access keys and long hexadecimal runs in whole texts. Every
base finding, and every other run of 16 or more token characters that has a digit and a letter, is a
candidate; the network reads its characters, in overlapping pieces if it is long, with the text before
and after it. It is trained (numpy, in tasks) on every document. Positive are all rule findings and, in their places
without the key word, random values of other alphabets, cases and prefixes that no rule matches. Negative
are each text's longest ordinary run, all candidates of short parts (ids, dates, paths), and words, dates and numbers
joined to such ids in the places of findings; all other candidates are unlabelled and left out. Equal examples are
folded and counted, then dealt by hash to shards of bounded size; each shard trains on all of its own, and the weights
are averaged after each round. Its logits are calibrated (Platt) on the quarter of texts that the fit does not see, all of
them, and the threshold is the largest that keeps ``recall`` of their positives. Candidates outside base findings that reach it are added as ``learned``
spans; base spans always stay.

Texts are read whole, whatever their length. Offsets are in code points, ends exclusive. Null or empty texts have no spans. With too few positives
to train on, only base spans are returned. Repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.llm.labelled import platt, sigmoid
from kinweave.plans.storage import Scratch

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
VALUE, KEY, HEX, CANDIDATE = 8, 16, 32, 16
LEFT, MIDDLE, RIGHT = 24, 40, 16
WIDTH, EMBED, FILTERS, ALPHABET = 5, 8, 24, 100
_HEXES, _TOKEN, _DIGIT, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_HEXES[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_TOKEN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
#: 0 outside the text, 1..95 printable ASCII, 96 line breaks and tabs, 97 other control bytes, 98 and 99 UTF-8 bytes
_SYMBOL = np.full(256, 97, np.uint8)
_SYMBOL[32:127] = np.arange(1, 96)
_SYMBOL[[9, 10, 13]] = 96
_SYMBOL[128:192], _SYMBOL[192:] = 98, 99
SCHEMA = "doc_id long, spans array<struct<kind:int,start:long,end:long,score:double>>"
EXAMPLE = "window binary, label int, held boolean"
#: Distinct examples of a shard, passes over a single shard, rounds of one pass over several, steps of a logit's grid.
SHARD, EPOCHS, ROUNDS, GRID = 1 << 14, 8, 4, 1024


def base_spans(text: tb.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end) in bytes of the chunk. Documents are parted by line feeds, which no rule crosses."""
    shift = np.arange(text.n)
    joined = np.full(len(text.raw) + text.n, 10, np.uint8)
    doc = np.repeat(shift, np.diff(text.off))
    joined[np.arange(len(text.raw)) + doc] = text.raw
    whole = joined.tobytes()
    begin = text.off[:-1] + shift
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(whole) if m.end(1) - m.start(1) >= VALUE]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(whole) if m.end() - m.start() >= KEY]
    kind, start, end = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    owner = np.searchsorted(begin, start, side="right") - 1
    a, b = text.runs(_HEXES[text.raw])
    long = b - a >= HEX
    return np.concatenate((kind, np.full(long.sum(), 2))), np.concatenate((start - owner, a[long])), np.concatenate((end - owner, b[long]))


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes before each place are in one of the spans."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))


def other_candidates(text: tb.Text, start: np.ndarray, end: np.ndarray, beside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Token runs with a digit and a letter that touch no base span; with ``beside``, also those that base spans do not cover whole."""
    a, b = text.runs(_TOKEN[text.raw])
    long = b - a >= CANDIDATE
    a, b = a[long], b[long]
    digits, letters = (np.zeros(len(text.raw) + 1, np.int64) for _ in range(2))
    np.cumsum(_DIGIT[text.raw], out=digits[1:])
    np.cumsum(_ALPHA[text.raw], out=letters[1:])
    taken = covered(len(text.raw), start, end)
    ok = (digits[b] > digits[a]) & (letters[b] > letters[a]) & (taken[b] - taken[a] < (b - a if beside else 1))
    return a[ok], b[ok]


def windows(text: tb.Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Symbols of the text before, the candidate's first and last characters, and the text after."""
    owner = np.searchsorted(text.off, start, side="right") - 1
    lo, hi = text.off[owner][:, None], text.off[owner + 1][:, None]
    half = MIDDLE // 2
    head, tail = start[:, None] + np.arange(half), end[:, None] + np.arange(-half, 0)
    at = np.concatenate((start[:, None] + np.arange(-LEFT, 0), head, tail, end[:, None] + np.arange(RIGHT)), 1)
    inside = (at >= lo) & (at < hi)
    inside[:, LEFT : LEFT + half] &= head < end[:, None]
    inside[:, LEFT + half : LEFT + MIDDLE] &= tail >= start[:, None]
    return np.where(inside, _SYMBOL[text.raw[np.clip(at, 0, max(len(text.raw) - 1, 0))]], 0) if len(text.raw) else np.zeros((0, at.shape[1]), np.uint8)


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, start, end) of overlapping pieces of at most ``MIDDLE`` bytes that together hold every byte."""
    half = MIDDLE // 2
    each = np.maximum(1, -(-(end - start) // half) - 1)
    owner = np.repeat(np.arange(len(start)), each)
    first = start[owner] + half * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
    return owner, first, np.minimum(first + MIDDLE, end[owner])


def short_parts(text: tb.Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run falls into parts of under 12 bytes at hyphens, underscores and slashes, as ids, dates and paths do."""
    raw = text.raw.tobytes()
    return np.array([max(map(len, re.split(rb"[-_/]", raw[a:b]))) < 12 for a, b in zip(start.tolist(), end.tolist(), strict=True)], bool)


_HEX_UPPER, _LETTERS_DIGITS, _BASE64 = b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ALPHABETS = (_HEX_UPPER, _HEX_UPPER.lower(), _LETTERS_DIGITS, _LETTERS_DIGITS[26:], _BASE64, _BASE64[:-2] + b"-_")


def made_values(r: np.random.Generator, n: int) -> list[bytes]:
    """Random values as keys and tokens have them, some with a vendor's kind of prefix."""
    out = []
    for _ in range(n):
        alphabet = np.frombuffer(_ALPHABETS[r.integers(len(_ALPHABETS))], np.uint8)
        value = r.choice(alphabet, r.integers(CANDIDATE, 97)).tobytes()
        lead = r.choice(np.frombuffer(_LETTERS_DIGITS[26:52], np.uint8), r.integers(2, 6)).tobytes()
        out.append([value, value, lead + b"_" + value, lead + b"-" + value][r.integers(4)])
    return out


def made_ids(r: np.random.Generator, n: int, words: list[bytes]) -> list[bytes]:
    """Ids of words, dates and numbers, of the lengths of candidates."""
    out = []
    for _ in range(n):
        parts, mark = [], [b"-", b"_", b"/"][r.integers(3)]
        while sum(map(len, parts)) + len(parts) <= CANDIDATE or r.random() < 0.3:
            year, month, day, number = r.integers([1950, 1, 1, 0], [2060, 13, 29, 10 ** r.integers(1, 9)])
            word = words[r.integers(len(words))] if words else b"id"
            parts.append([word, word.upper(), word.capitalize(), b"%d" % number, b"%04d%02d%02d" % (year, month, day), b"%04d-%02d-%02d" % (year, month, day), word + b"%d" % number][r.integers(7)])
        out.append(mark.join(parts))
    return out


def placed(text: tb.Text, start: np.ndarray, end: np.ndarray, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, place) of values in place of the spans, one after another and around again."""
    owner = np.searchsorted(text.off, start, side="right") - 1
    raw, texts, first = text.raw.tobytes(), [], []
    for k, value in enumerate(values):
        i = k % len(start)
        before = raw[max(text.off[owner[i]], start[i] - LEFT) : start[i]].decode(errors="ignore")
        texts.append(before + value.decode(errors="ignore") + raw[end[i] : min(text.off[owner[i] + 1], end[i] + RIGHT)].decode(errors="ignore"))
        first.append(len(before.encode()))
    made = tb.Text(pa.array(texts, pa.string()))
    a = made.off[:-1] + np.array(first, np.int64)
    of, a, b = pieces(a, a + np.array([len(v.decode(errors="ignore").encode()) for v in values], np.int64))
    return windows(made, a, b), of % max(len(start), 1)


WEIGHTS = ("embed", "conv", "bias", "out")
_PARTS = ((0, LEFT), (LEFT, LEFT + MIDDLE), (LEFT + MIDDLE, LEFT + MIDDLE + RIGHT))


@dataclass
class Network:
    """Embedding, one convolution with rectifier, maxima over left, candidate and right, logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0

    @classmethod
    def start(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (ALPHABET, EMBED)), r.normal(0, 0.15, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), np.append(r.normal(0, 0.1, len(_PARTS) * FILTERS), 0.0))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = np.pad(self.embed[x], ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1], -1)
        act = np.maximum(cols @ self.conv + self.bias, 0)
        peak = [act[:, a:b].argmax(1) + a for a, b in _PARTS]
        pooled = np.concatenate([np.take_along_axis(act, p[:, None], 1)[:, 0] for p in peak], 1)
        return pooled @ self.out[:-1] + self.out[-1], (cols, pooled, peak)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(x) + self.offset)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in WEIGHTS])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        """The network of these weights."""
        like = cls.start()
        cut = np.cumsum([getattr(like, k).size for k in WEIGHTS])[:-1]
        return cls(*(x.reshape(getattr(like, k).shape) for k, x in zip(WEIGHTS, np.split(flat, cut), strict=True)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        slow, fast = ({k: np.zeros_like(getattr(self, k)) for k in WEIGHTS} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 64):
                pick = order[at : at + 64]
                z, (cols, pooled, peak) = self.forward(x[pick])
                dz = (sigmoid(z) - y[pick]) / len(pick)
                dp = (dz[:, None] * self.out[:-1]).reshape(len(pick), len(_PARTS), FILTERS) * (pooled > 0).reshape(len(pick), len(_PARTS), FILTERS)
                dact = np.zeros((*cols.shape[:2], FILTERS))
                row, filt = np.arange(len(pick))[:, None], np.arange(FILTERS)[None]
                for k, p in enumerate(peak):
                    dact[row, p, filt] += dp[:, k]
                dcols = (dact @ self.conv.T).reshape(len(pick), cols.shape[1], WIDTH, EMBED)
                de = np.zeros((len(pick), cols.shape[1] + WIDTH - 1, EMBED))
                for j in range(WIDTH):
                    de[:, j : j + cols.shape[1]] += dcols[:, :, j]
                de = de[:, WIDTH // 2 : WIDTH // 2 + cols.shape[1]]
                dembed = np.stack([np.bincount(x[pick].ravel(), de[:, :, j].ravel(), ALPHABET) for j in range(EMBED)], 1)
                grads = {"embed": dembed, "conv": cols.reshape(-1, WIDTH * EMBED).T @ dact.reshape(-1, FILTERS), "bias": dact.sum((0, 1)), "out": np.append(pooled.T @ dz, dz.sum())}
                step += 1
                for k in WEIGHTS:
                    g = grads[k] + 1e-5 * getattr(self, k)
                    slow[k] = 0.9 * slow[k] + 0.1 * g
                    fast[k] = 0.99 * fast[k] + 0.01 * g**2
                    setattr(self, k, getattr(self, k) - rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.99**step)) + 1e-7))


def examples(seed: int):
    """Arrow batches of (text, own), ``own`` being a hash of the text, to the examples of every text. What is made up for a
    text depends on the text alone, so copies give equal examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.chunks(batches):
            text = tb.Text(tb.column(batch, "text"))
            own = tb.column(batch, "own").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            _, start, end = base_spans(text)
            order = np.lexsort((end, start))
            start, end = start[order], end[order]
            a, b = other_candidates(text, start, end)
            plain = short_parts(text, a, b)
            wa, wb = text.runs(_TOKEN[text.raw])
            taken = covered(len(text.raw), np.concatenate((start, a)), np.concatenate((end, b)))
            usual = taken[wb] == taken[wa]  # neither a finding nor a candidate is in it
            wa, wb = wa[usual], wb[usual]
            edges = np.searchsorted(wa, text.off)
            longest = np.maximum.reduceat(wb - wa << 32 | len(text.raw) - wa, edges[:-1][np.diff(edges) > 0]) if len(wa) else wa
            la = len(text.raw) - (longest & 0xFFFFFFFF)
            first, last = np.concatenate((start, a[plain], la)), np.concatenate((end, b[plain], la + (longest >> 32)))
            label = np.concatenate((np.ones(len(start), np.int32), np.zeros(plain.sum() + len(la), np.int32)))
            of, first, last = pieces(first, last)
            xs, ys, docs = [windows(text, first, last)], [label[of]], [np.searchsorted(text.off, first, side="right") - 1]
            if len(start):
                where = np.searchsorted(text.off, start, side="right") - 1
                values, ids = [], []
                for d, n in zip(*(x.tolist() for x in np.unique(where, return_counts=True)), strict=True):
                    r = np.random.default_rng([seed, int(own[d])])
                    words = [text.raw[i:j].tobytes() for i, j in zip(wa[edges[d] : edges[d + 1]].tolist(), wb[edges[d] : edges[d + 1]].tolist(), strict=True) if j - i < 12]
                    values += made_values(r, 2 * n)
                    ids += made_ids(r, 2 * n, words)
                for put, is_secret in ((values, 1), (ids, 0)):
                    made, at = placed(text, np.repeat(start, 2), np.repeat(end, 2), put)
                    xs.append(made)
                    ys.append(np.full(len(made), is_secret, np.int32))
                    docs.append(np.repeat(where, 2)[at])
            x = np.concatenate(xs).astype(np.uint8)
            held = tb.mix(own[np.concatenate(docs)]) % np.uint64(4) == 0
            edge = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
            window = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(edge), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([window, pa.array(np.concatenate(ys)), pa.array(held)], ["window", "label", "held"])

    return run


def _windows_of(window: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(window.to_pylist()), np.uint8).reshape(-1, LEFT + MIDDLE + RIGHT)


def shard(network, epochs: int):
    """The weights after ``epochs`` passes over a shard, times its examples; as whole numbers, which sum up alike in any order."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("window", "ascending"), ("label", "ascending")])
        net = Network.of(network.value)
        net.train(_windows_of(group["window"]), group["label"].to_numpy(), epochs)
        total = np.rint(net.flat() * (1 << 24)).astype(np.int64) * group.num_rows
        return pa.table({"place": pa.array(np.arange(len(total), dtype=np.int32)), "total": total})

    return run


def fit(docs: DataFrame, recall: float = 0.99, seed: int = 3, shard_rows: int = SHARD) -> Network:
    """Trained, calibrated and given its threshold on the examples of all texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("own", F.xxhash64("text", F.lit(seed)))
    rows = scratch.keep(texts.mapInArrow(examples(seed), EXAMPLE).groupBy("window", "label", "held").agg(F.count("*").alias("n")), "examples")
    sizes = {(r["label"], r["held"]): r for r in rows.groupBy("label", "held").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    there = {k: r["n"] for k, r in sizes.items()}
    net = Network.start()
    if there.get((1, False), 0) < 10 or there.get((0, False), 0) < 10 or there.get((1, True), 0) < 5:
        scratch.drop()
        return net
    distinct = sum(r["distinct"] for (_, held), r in sizes.items() if not held)
    shards = -(-distinct // shard_rows)
    learned = rows.where("not held").select(F.pmod(F.xxhash64("window", "label"), F.lit(shards)).alias("shard"), "window", "label")
    weights = net.flat()
    for _ in range(ROUNDS if shards > 1 else 1):
        sent = spark.sparkContext.broadcast(weights)
        got = learned.groupBy("shard").applyInArrow(shard(sent, 1 if shards > 1 else EPOCHS), "place int, total long")
        got = got.groupBy("place").agg(F.sum("total").alias("total")).collect()  # a number a weight
        for r in got:
            weights[r["place"]] = r["total"] / distinct / (1 << 24)
    net = Network.of(weights)
    sent = spark.sparkContext.broadcast(weights)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of(sent.value)
        for batch in batches:
            z = np.floor(np.clip(own.logits(_windows_of(tb.column(batch, "window"))), -40, 40) * GRID)
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), tb.column(batch, "label"), tb.column(batch, "n")], ["z", "label", "n"])

    # every held example counts; logits are told apart to 1 / GRID, which bounds the counts
    counts = rows.where("held").mapInArrow(logits, "z int, label int, n long").groupBy("z", "label").agg(F.sum("n").alias("n")).orderBy("z", "label").toArrow()
    z, y, n = counts["z"].to_numpy() / GRID, counts["label"].to_numpy().astype(float), counts["n"].to_numpy()
    net.slope, net.offset = platt(z, y, n.astype(float))
    z, n = z[y > 0], n[y > 0]
    net.threshold = float(sigmoid(net.slope * z[np.searchsorted(np.cumsum(n), int((1 - recall) * n.sum()), side="right")] + net.offset))
    scratch.drop()
    return net


def scan(network):
    """Arrow batches of (doc_id, text) to spans; ``network`` is a broadcast of a ``Network``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in tb.chunks(batches):
            text = tb.Text(tb.column(batch, "text"))
            kind, start, end = base_spans(text)
            a, b = other_candidates(text, start, end, beside=True)
            first, last = np.concatenate((start, a)), np.concatenate((end, b))
            of, a_, b_ = pieces(first, last)
            score = np.zeros(len(first))
            np.maximum.at(score, of, net.probability(windows(text, a_, b_)))
            kind = np.concatenate((kind, np.full(len(a), 3)))
            keep = (kind < 3) | (score >= net.threshold)
            kind, first, last, score = kind[keep], first[keep], last[keep], score[keep]
            owner = np.searchsorted(text.off, first, side="right") - 1
            order = np.lexsort((kind, first, owner))
            points = np.concatenate(([0], np.cumsum((text.raw & 0xC0) != 0x80)))
            zero = points[text.off[:-1]][owner]
            parts = [kind, points[first] - zero, points[last] - zero, score]
            parts = [x[order] for x in parts]
            edges = np.searchsorted(owner[order], np.arange(text.n + 1))
            spans = pa.StructArray.from_arrays([pa.array(parts[0].astype(np.int32)), pa.array(parts[1]), pa.array(parts[2]), pa.array(parts[3])], names=["kind", "start", "end", "score"])
            yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), spans)], ["doc_id", "spans"])

    return run


def secrets(docs: DataFrame, **fitting) -> DataFrame:
    """(doc_id, spans) of every document; ``KINDS[kind]`` names a span's kind."""
    network = docs.sparkSession.sparkContext.broadcast(fit(docs, **fitting))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scan(network), SCHEMA)


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of these kinds, comma-joined (a column)."""
    names = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: F.element_at(names, s["kind"] + 1).isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", **fitting) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; all columns and rows stay, in one pass over the texts."""
    spark = docs.sparkSession
    network = spark.sparkContext.broadcast(fit(docs, **fitting))
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.chunks(batches):
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place)], ["doc_id", "text"])
            found = pa.Table.from_batches(scan(network)(iter([plain])))["spans"].to_pylist()
            texts = batch.column(place).to_pylist()
            for r, spans in enumerate(found):
                if spans:
                    out, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            out += [texts[r][at : s["start"]], mark]
                        at = max(at, s["end"])
                    texts[r] = "".join([*out, texts[r][at:]])
            columns = batch.columns
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
