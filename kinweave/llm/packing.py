"""Best-fit packing planned on a length histogram.

Texts are tokenised once, in Arrow batches; only piece lengths and checksums (or, if asked for, the
ids) are kept. The histogram of piece lengths, at most ``capacity`` numbers, is packed best-fit
decreasing over *counts*: bins with the same free space form one group, so the plan has at most
``4 * capacity * log2(capacity)`` rows whatever the corpus holds, and may be broadcast. Each piece
then takes its planned slot by its rank among pieces of its length. Ranks come from counts by
(length, part) and a row number inside a part, so that a length which a third of all pieces share is
spread over all parts.

Null text counts as empty; an empty document is the single end id. Texts are read whole, whatever their length and
characters. Documents longer than the
capacity are cut into full pieces, the first taking the remainder. Repeated rows are packed again
each, a null id stays null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.plans.storage import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Runs of white space with the text after them. A byte-level BPE of this family never merges across such a start:
#: words begin with at most one space, and what a run of white space becomes depends on what follows it alone. Other
#: white space and characters that some Unicode versions count as such start nothing.
CHUNK = re.compile("[\\s\u180e\u200b\ufeff]*[^\\s\u180e\u200b\ufeff]+(?:[\v\f\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff][\\s\u180e\u200b\ufeff]*[^\\s\u180e\u200b\ufeff]*)*|[\\s\u180e\u200b\ufeff]+")
#: The same, and runs of Latin letters, ASCII digits and marks that nothing but another kind of ASCII character follows: they
#: are words of their own too. Apostrophes (contractions) and all else stay with what is next to them.
FINE = re.compile(r"[ \n\t\r]*(?:[A-Za-zÀ-ÖØ-öø-ſ]++(?![\x80-\U0010ffff])|[0-9]++(?![\x80-\U0010ffff])|[!-&(-/:-@\[-`{-~]++(?!['\x80-\U0010ffff]))|" + CHUNK.pattern)
#: Latin letters, digits or marks with at most one space before them are one word, whatever stands around them.
WORD = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ſ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch
#: How a byte-level vocabulary writes bytes: printable ones as they are, others by the letters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
WRITTEN = "".join(chr(b if b in _PRINTED else 256 + _OTHERS.index(b)) for b in range(256))
#: Longer chunks are encoded each time. What a remembered chunk takes besides its characters and ids, in bytes.
SHORT, ENTRY = 40, 190


class _Known(dict):
    """Ids by chunk; those of a chunk that is not there are asked for."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, chunk: str) -> bytes:
        return self.ask(chunk)


class Encoder:
    """Ids of whole texts as little-endian bytes, by ``tokenizers``. Texts are encoded chunk by chunk, and each task
    remembers short chunks in two generations of at most ``remember`` bytes; special tokens in a text count as such."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, remember: int = 48 << 20):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker a core
        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        plain = type(self.model.pre_tokenizer).__name__ == "ByteLevel" and not self.model.normalizer and not any(map(WORD, self.special))
        self.words = self.model.model if plain else None
        self.remember, self.held = remember, 0
        self.known, self.older = _Known(self._ids), {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Workers outlive their tasks: what is remembered goes with the task, or it stays beside all later stages."""
        self.known, self.older, self.held = _Known(self._ids), {}, 0

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk that is not remembered; if it is short, it is from now on."""
        ids = self.older.get(chunk)
        if ids is None:
            if self.words and WORD(chunk):  # what is a word for sure goes to the merges at once
                got = [t.id for t in self.words.tokenize(charmap_decode(chunk.encode(), "strict", WRITTEN)[0])]
            else:
                got = self.model.encode([chunk], is_pretokenized=True, add_special_tokens=False).ids
            ids = array("I", got).tobytes()
        if len(chunk) <= SHORT:
            self.known[chunk] = ids
            self.held += ENTRY + len(chunk) + len(ids)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Chunks met lately are looked up; those not met since the last change of generations are forgotten."""
        if self.held > self.remember:
            self.known, self.older, self.held = _Known(self._ids), self.known, 0
        ids = self.known.__getitem__
        return [b"".join(map(ids, (CHUNK if any(s in t for s in self.special) else FINE).findall(t))) for t in texts]


def cut_pieces(path: str, capacity: int, end_id: int, with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], "<u4").tobytes()
        try:
            for batch in tb.chunks(batches):
                texts = [t or "" for t in tb.column(batch, "text").to_pylist()]
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, got in enumerate(encoder.encode(texts)):
                    got += end
                    n = len(got) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = at + (capacity if k or not n % capacity else n % capacity)
                        part = got[4 * at : 4 * to]
                        rows.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(part))
                        ids.append(part)
                        at = to
                out = {"doc_id": tb.column(batch, "doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32())}
                out |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))
        finally:
            encoder.forget()

    return run


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, per sequence, offset) rows; sequences are numbered from 0."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, sequences)
    made = 0

    def put(space: int, first: int, count: int) -> None:
        if count and space:
            free.setdefault(space, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = min((s for s in free if s >= length), default=None)
            if space is None:
                space, first = capacity, made
                count = -(-left // (capacity // length))
                made += count
            else:
                first, count = free[space].pop()
                if not free[space]:
                    del free[space]
            each = space // length
            full, rest = min(count, left // each), 0
            if full:
                plan.append((length, rank, full * each, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:
                rest = 1
                plan.append((length, rank, left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                rank, left = rank + left, 0
            put(space, first + full + rest, count - full - rest)
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, part_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.keep(texts.mapInArrow(cut_pieces(tokenizer, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else "")), "pieces")
    parts = max(256, pieces.count() // part_rows + 1)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = scratch.keep(pieces.groupBy("length", "part").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    plan = spark.createDataFrame(best_fit(histogram, capacity), "length long, first long, ranks long, sequence long, each long, base long")
    slot = F.col("rank") - F.col("first")
    out = ranked.join(F.broadcast(plan), "length").where((slot >= 0) & (slot < F.col("ranks")))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return out.select(*kept, (F.col("sequence") + F.floor(slot / F.col("each"))).alias("sequence_id"), (F.col("base") + slot % F.col("each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from ``pack(..., with_ids=True)``; a sequence holds at most ``capacity`` ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
