"""Language ID by prediction by partial matching (PPM) with frozen statistics.

Each language has a byte context tree of order 0 to 3 with escapes (method C): a byte seen after a
context costs ``-log2 count / (total + kinds)`` there; otherwise the escape ``kinds / (total + kinds)``
is paid and the next shorter context decides, down to the uniform model over all 256 bytes. ASCII case is
folded. With statistics frozen after fitting, the code length of a byte depends on itself and its last
three bytes only: the lengths of all byte runs seen in any language are worked out once, and the exact code
length of whole texts, whatever their length, is looked up and summed. Memory follows the contexts seen; no
byte, language or context is merged away.

The prediction is the language of the shortest code, its score the posterior probability under equal
priors. Texts that are null or hold no letter are ``und`` with score 0. With no labelled text every
text is ``und``. Ties go to the first language by name. Rows that repeat an id get each the result of their
own text; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb
from kinweave.plans.storage import Scratch

ORDER = 3
SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _codes(text: tb.Text) -> np.ndarray:
    """The last three bytes and the byte's own as one number; documents begin as after spaces."""
    now = tb.LOWER[text.raw].astype(np.uint32)
    inner = text.off[:-1][text.off[:-1] < len(now)]
    out, back = now.copy(), now
    for k in range(1, ORDER + 1):
        back = np.concatenate((np.array([32], np.uint32), back[:-1])) if len(back) else back
        back[inner] = 32
        out |= back << np.uint32(8 * k)
    return out


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of ``n``."""
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, n, len(codes)) if len(codes) else np.zeros(0)


class _Order:
    """One language's contexts of one order: sorted codes (context and byte) with counts, contexts with totals and kinds."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n
        self.context, at = np.unique(codes >> np.uint32(8), return_inverse=True)
        total, self.kinds = np.bincount(at, n, len(self.context)), np.bincount(at, minlength=len(self.context))
        self.bottom = total + self.kinds

    @staticmethod
    def _at(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
        return np.where(known[at] == asked, at, -1) if len(known) else np.full(len(asked), -1)

    def escape(self, context: np.ndarray) -> np.ndarray:
        """Bits of the escape from each context; none from one never seen."""
        at = self._at(self.context, context)
        return np.where(at >= 0, np.log2(self.bottom[at] / self.kinds[at]), 0.0) if len(self.context) else np.zeros(len(context))

    def bits(self, codes: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Bits of each code, ``shorter`` being those of the next shorter context."""
        out = self.escape(codes >> np.uint32(8)) + shorter
        at = self._at(self.codes, codes)
        seen = np.flatnonzero(at >= 0)
        bottom = self.bottom[self._at(self.context, codes[seen] >> np.uint32(8))]
        out[seen] = np.log2(bottom / self.n[at[seen]])
        return out


class Trees:
    """Code lengths of the byte runs seen, a column for each language; what is not seen is put together from escapes."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.four = np.unique(np.concatenate([np.zeros(0, np.uint32), *(c for c, _ in counts)]))
        self.three = np.unique(np.concatenate((self.four & np.uint32(0xFFFFFF), self.four >> np.uint32(8))))
        pairs = np.arange(1 << 16, dtype=np.uint32)
        width = len(languages)
        #: bits of runs of two, three and four bytes, and of the escapes from contexts of two and three bytes
        self.bits_2, self.bits_3, self.bits_4 = (np.zeros((n, width), np.float32) for n in (1 << 16, len(self.three), len(self.four)))
        self.escape_2, self.escape_3 = (np.zeros((n, width), np.float32) for n in (1 << 16, len(self.three) + 1))
        for k, (codes, n) in enumerate(counts):
            orders = [_Order(*_summed(codes & np.uint32((1 << 8 * (o + 1)) - 1), n)) for o in range(ORDER)] + [_Order(codes, n)]
            single = orders[0].bits(np.arange(256, dtype=np.uint32), np.full(256, 8.0))
            two = orders[1].bits(pairs, single[pairs & np.uint32(255)])
            three = orders[2].bits(self.three, two[self.three & np.uint32(0xFFFF)])
            shorter = three[np.searchsorted(self.three, self.four & np.uint32(0xFFFFFF))]
            self.bits_2[:, k], self.bits_3[:, k], self.bits_4[:, k] = two, three, orders[3].bits(self.four, shorter)
            self.escape_2[:, k], self.escape_3[:-1, k] = orders[2].escape(pairs), orders[3].escape(self.three)
        #: Bits per byte above which a text is in none of the languages; set by ``fit`` where it holds texts back.
        self.limits = np.full(width, np.inf)
        self._places = None

    def size(self) -> int:
        return sum(x.nbytes for x in (self.four, self.three, self.bits_2, self.bits_3, self.bits_4, self.escape_2, self.escape_3))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}

    @staticmethod
    def _hashed(codes: np.ndarray) -> list[tuple[np.uint32, np.uint32, np.ndarray]]:
        """(multiplier, shift, places): the index of each code at its hashed place in the first table where it met no other."""
        bits = max(12, int(np.ceil(np.log2(max(len(codes), 1)))) + 2)
        tables, left = [], np.arange(len(codes))
        while len(left):
            factor, shift = np.uint32(0x9E3779B1 + 2 * 0x3C6EF35F * len(tables) & 0xFFFFFFFF | 1), np.uint32(32 - bits)
            table = np.full(1 << bits, -1, np.int32)
            at = codes[left] * factor >> shift
            table[at] = left
            tables.append((factor, shift, table))
            left = left[table[at] != left]
        return tables

    @staticmethod
    def _found(codes: np.ndarray, tables: list, asked: np.ndarray) -> np.ndarray:
        """The index of each asked code, -1 if it is none of the codes."""
        out = np.full(len(asked), -1, np.int32)
        rows = np.arange(len(asked))
        for factor, shift, table in tables:
            found = table[asked[rows] * factor >> shift]
            taken = np.flatnonzero(found >= 0)  # where nothing is, no later table has the code
            rows, found = rows[taken], found[taken]
            ok = codes[found] == asked[rows]
            out[rows[ok]] = found[ok]
            rows = rows[~ok]
        return out

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        if self._places is None:  # built once per process
            self._places = self._hashed(self.three), self._hashed(self.four)
        three, four = self._places
        at = self._found(self.four, four, codes)
        out = self.bits_4[at] if len(self.four) else np.zeros((len(codes), len(self.languages)), np.float32)
        rows = np.flatnonzero(at < 0)
        if len(rows):
            own = codes[rows]
            context, short = (self._found(self.three, three, x) for x in (own >> np.uint32(8), own & np.uint32(0xFFFFFF)))
            less = self.escape_2[own >> np.uint32(8) & np.uint32(0xFFFF)] + self.bits_2[own & np.uint32(0xFFFF)]
            known = np.flatnonzero(short >= 0)
            less[known] = self.bits_3[short[known]]
            out[rows] = self.escape_3[context] + less  # the last row, for contexts never seen, is zero
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of each chunk of (lang, text)."""
    for batch in tb.chunks(batches):
        text, lang = tb.Text(tb.column(batch, "text")), tb.column(batch, "lang").dictionary_encode()
        owner = np.repeat(lang.indices.to_numpy().astype(np.int64), np.diff(text.off))
        both, n = np.unique(owner << 32 | _codes(text), return_counts=True)
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(both >> 32)), pa.array(both & 0xFFFFFFFF), pa.array(n)], ["lang", "code", "n"])


def _picked(docs: DataFrame, where: Column | None, per_language: int, languages: int, total: int, seed: int) -> DataFrame | None:
    """(id, lang) of at most ``per_language`` rows of each language, by a hash of their ids, in two scans of the labels."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    rows = rows if where is None else rows.where(where)
    sizes = rows.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"lang has more than {languages} values; raise languages= if they are languages")
    if not sizes:
        return None
    per_language = max(1, min(per_language, total // len(sizes)))
    # a hash below the limit keeps about a fifth more rows than wanted, whatever the language's size
    limits = [(r["lang"], min(1 << 30, (1 << 30) * (per_language + per_language // 5 + 20) // r["count"] + 1)) for r in sizes]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most long")
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)))
    some = rows.join(F.broadcast(limits), "lang").where("_h < most").select("doc_id", "lang", "_h").distinct()
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_n") <= per_language)
    return some.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))


def fit(docs: DataFrame, where: Column | None = None, per_language: int = 1000, languages: int = 1000, total: int = 100_000, model_mb: int = 600, seed: int = 11, hold: int = 0) -> Trees:
    """From at most ``per_language`` documents of each language, ``total`` in all, by a hash of their ids. More
    than ``languages`` languages, or code lengths of more than ``model_mb`` MB (they go to every worker), are an error.

    With ``hold``, one in ``hold`` of these is kept from the trees and sets its language's limit: as far above the
    median as four times the 95th percentile is. Languages with under 20 texts kept get none.
    """
    picks = _picked(docs, where, per_language, languages, total, seed)
    if picks is None:
        return Trees([], [])
    picks = Scratch(docs.sparkSession).keep(picks, "picks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ids and languages of at most ``total`` rows
    texts = texts.join(F.broadcast(picks), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")
    back = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(hold or 1)) == 0
    learned = texts.where(~back) if hold else texts
    got = learned.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = Scratch(docs.sparkSession).keep(got, "contexts")
    if 4 * got.count() > model_mb << 20:  # a context takes that at least
        raise ValueError(f"code lengths take more than {model_mb} MB: lower per_language, or raise model_mb if workers have the memory")
    got = got.toArrow()
    known = sorted(r["_lang"] for r in picks.select("_lang").distinct().collect())
    place = pc.index_in(got["lang"], pa.array(known, pa.string())).to_numpy()
    codes, n = got["code"].to_numpy().astype(np.uint32), got["n"].to_numpy()
    counts = []
    for k in range(len(known)):
        own = np.flatnonzero(place == k)
        own = own[np.argsort(codes[own])]
        counts.append((codes[own], n[own].astype(np.float64)))
    trees = Trees(known, counts)
    if trees.size() > model_mb << 20:
        raise ValueError(f"code lengths take {trees.size() >> 20} MB: lower per_language, or raise model_mb if workers have the memory")
    if hold:
        shared = docs.sparkSession.sparkContext.broadcast(trees)

        def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for batch in tb.chunks(batches):
                text = tb.Text(tb.column(batch, "text"))
                size = np.diff(text.off)
                own = pc.index_in(tb.column(batch, "lang"), pa.array(t.languages, pa.string())).to_numpy()
                each = t.code_lengths(_codes(text))[np.arange(len(text.raw)), np.repeat(own, size)]
                rate = tb.per_doc(each.astype(np.float64), text.off) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([pa.array(own[size > 0].astype(np.int32)), pa.array(rate[size > 0])], ["own", "rate"])

        found = texts.where(back).mapInArrow(rates, "own int, rate double").toArrow()
        own, rate = found["own"].to_numpy(), found["rate"].to_numpy()
        for k in range(len(known)):
            if (own == k).sum() >= 20:
                middle, high = np.quantile(rate[own == k], [0.5, 0.95])
                trees.limits[k] = middle + 4 * (high - middle)
    return trees


def _has_letter(text: tb.Text) -> np.ndarray:
    plain = tb.per_doc(_LETTER[text.raw].astype(np.int64), text.off) > 0
    for d in np.flatnonzero(~plain & (tb.per_doc((text.raw > 127).astype(np.int64), text.off) > 0)):
        plain[d] = any(c.isalpha() for c in text.raw[text.off[d] : text.off[d + 1]].tobytes().decode())
    return plain


def predict(trees):
    """Arrow batches of (doc_id, text) to predictions; ``trees`` is a broadcast of ``Trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trees.value
        names = np.array([*t.languages, "und"], object)
        for batch in tb.chunks(batches, limit=1 << 20):
            text = tb.Text(tb.column(batch, "text"))
            known = _has_letter(text) & (len(t.languages) > 0)
            best, score, rate = np.full(text.n, len(t.languages)), np.zeros(text.n), np.zeros(text.n)
            if known.any():
                each = t.code_lengths(_codes(text))
                filled = np.flatnonzero(np.diff(text.off) > 0)
                bits = np.zeros((text.n, len(t.languages)))
                bits[filled] = np.add.reduceat(each, text.off[:-1][filled], axis=0, dtype=np.float64)
                least = bits.argmin(1)
                gap = np.minimum((bits - bits.min(1, keepdims=True)) * np.log(2), 700)
                best = np.where(known, least, best)
                score = np.where(known, 1 / np.exp(-gap).sum(1), 0.0)
                rate = np.where(known, bits.min(1) / np.maximum(np.diff(text.off), 1), 0.0)
            yield pa.RecordBatch.from_pydict({"doc_id": tb.column(batch, "doc_id"), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score), "bits_per_byte": pa.array(rate)})

    return run


def language(docs: DataFrame, where: Column | None = None, **fitting) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every document, learned from the rows of ``docs`` that ``where`` selects."""
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, where, **fitting))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(predict(trees), SCHEMA)


def told_apart(docs: DataFrame, sure: float, where: Column | None = None, **fitting) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with a score of ``sure`` or more and that it explains within
    its limit of bits per byte, ``lang`` set to the prediction, with all their columns, in one pass and without a
    shuffle. Short texts vary more and get more room. If no language was learned, all rows stay as they are."""
    fitted = fit(docs, where, **({"hold": 5} | fitting))
    if not fitted.languages:
        return docs
    trees = docs.sparkSession.sparkContext.broadcast(fitted)

    def decide(rows: pa.RecordBatch, found: pa.RecordBatch) -> pa.RecordBatch:
        t = trees.value
        lang, score = tb.column(found, "lang_pred"), tb.column(found, "score")
        columns = [lang if name == "lang" else rows.column(i) for i, name in enumerate(rows.schema.names)]
        size = np.maximum(np.diff(tb.buffer(tb.column(rows, "text"))[1]), 1)
        rate = tb.column(found, "bits_per_byte").to_numpy()
        limit = dict(zip(t.languages, t.limits.tolist(), strict=True))
        near = rate <= np.array([limit.get(x, np.inf) for x in lang.to_pylist()]) + 6 / np.sqrt(size)
        ok = pc.and_(pc.and_(pc.not_equal(lang, "und"), pc.greater_equal(score, sure)), pa.array(near))
        return pa.RecordBatch.from_arrays(columns, rows.schema.names).filter(ok)

    return docs.mapInArrow(tb.beside(predict(trees), decide), docs.schema)
