"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A BPE piece model is run with its agenda of candidate merges (best piece first, ties leftmost). Each
candidate is skipped if a keyed hash of the seed, the document, the word's number in it and the
candidate's number in the word's agenda falls below ``dropout``; a skipped candidate stays skipped,
merges that others bring about draw their own. So every occurrence of a word draws anew, a seed gives one
segmentation of merge type, repeatable on any executor, and ``dropout=0`` gives the model's own encoding.

No piece of such a model reaches past a word's end, so words are encoded apart. What an agenda becomes is
decided by the numbers of the candidates that it skips: each worker keeps, for words met more than once
lately, a tree of these numbers with the ids that they lead to, bounded in size, and looks occurrences up in
it side by side. Other occurrences are encoded side by side.

Characters without a piece become byte pieces, and so does U+2581, which the model uses for a space;
decoding joins the pieces' bytes and is exact for every text. Null texts have null ids; empty texts
have none. Texts are read whole, whatever their length. Rows that repeat an id and a text get equal ids; a
null id counts as 0. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import textbatch as tb

SPACE = "▁"
CHUNK = re.compile(r" *[^ \n]+| +|\n")
_M = (1 << 64) - 1
_NONE = float("inf")
#: Words of more characters keep their agenda in a heap.
LONG = 200
#: Words of at most so many characters are encoded side by side; no agenda of theirs has more than 60 candidates.
WIDE, DRAWS = 21, 64
#: Words looked up at once, and tree nodes remembered.
AT_ONCE, REMEMBER = 1 << 17, 1 << 18


def _mixed(x: int) -> int:
    """``tb.mix`` of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def word_keys(seed: int, doc: int, words: int) -> np.ndarray:
    """A key for each word of a document."""
    base = _mixed((_mixed(seed & _M) + doc) & _M)
    return tb.mix(np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(base))


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after another."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Pieces:
    """A piece model with a bounded memory of encoded words."""

    _made: dict[tuple, Pieces] = {}

    def __init__(self, path: str, dropout: float, seed: int, remember: int = REMEMBER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.id[piece], self.rank[piece] = i, -sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(re.search(f"\n|[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("pieces of this model reach past a word's end")
        self.seed, self.limit = seed, round(dropout * (1 << 16))
        self.remember = remember
        self.size = np.array([len(b) for b in self.bytes_of])
        self.flat, self.at = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(self.size) - self.size
        self._tabulate()
        self._forget()

    def _tabulate(self) -> None:
        """Mergeable pairs as sorted keys with the merged symbol and its rank; symbols are pieces, then lone characters."""
        symbol = dict(self.id)
        for c in sorted(set("".join(self.id))):
            symbol.setdefault(c, len(self.size) + len(symbol))
        pairs = {}
        for piece in self.id:
            for cut in range(1, len(piece)):
                a, b = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = piece
        #: The symbol of each character up to U+FFFF (-1 if it has none); a space is U+2581, which itself has none.
        self.letters = np.full(1 << 16, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1 and ord(c) < len(self.letters) - 1:
                self.letters[ord(c)] = i
        self.letters[32], self.letters[ord(SPACE)] = symbol[SPACE], -1
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([symbol[pairs[k]] for k in self.pair.tolist()], np.int32)
        self.pair_rank = np.array([self.rank[pairs[k]] for k in self.pair.tolist()], np.float32)
        #: (multiplier, places): each pair's index at its hashed place in the first table where it met no other.
        self.places: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(self.pair))
        while len(left):
            factor = np.uint64(_mixed(len(self.places) + 1) | 1)
            table = np.full(1 << 20, -1, np.int32)
            at = self.pair[left].astype(np.uint64) * factor >> np.uint64(44)
            table[at] = left
            self.places.append((factor, table))
            left = left[table[at] != left]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each pair of symbols, -1 if they make no piece."""
        pair = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 20 | b, -1)
        out = np.full(len(pair), -1, np.int32)
        rows = np.arange(len(pair))
        for factor, table in self.places:
            own = pair[rows]
            found = table[own.astype(np.uint64) * factor >> np.uint64(44)]
            taken = np.flatnonzero(found >= 0)  # where nothing is, no later table has the pair
            rows, found = rows[taken], found[taken]
            ok = self.pair[found] == own[taken]
            out[rows[ok]] = found[ok]
            rows = rows[~ok]
        return out

    def _forget(self) -> None:
        """An empty tree: by node its word, the candidates skipped, how many candidates it saw, its children, its ids."""
        self.root: dict[str, int] = {}
        self.word_of: list[str] = []
        self.nodes = 0
        self.skipped, self.seen = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.child = np.full((1024, DRAWS), -1, np.int32)
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.held = np.zeros(1 << 13, "<u4"), 0

    def _add(self, words: list[str], skipped: np.ndarray) -> np.ndarray:
        """New nodes."""
        ids, count, seen = self.side_by_side(words, skipped)
        new = np.arange(self.nodes, self.nodes + len(words))
        self.nodes += len(words)
        if self.nodes > len(self.seen):
            room = max(self.nodes, 2 * len(self.seen)) - len(self.seen)
            for name in ("skipped", "seen", "first", "count"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(room, old.dtype))))
            self.child = np.concatenate((self.child, np.full((room, DRAWS), -1, np.int32)))
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(ids), len(self.ids)), "<u4")))
        self.word_of += words
        self.skipped[new], self.seen[new], self.count[new] = skipped, seen, count
        self.first[new] = self.held + np.cumsum(count) - count
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        return new

    def draws(self, key: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """For each word the candidates that its key skips, as bits; ``longest`` bounds their number."""
        bits = np.zeros(len(key), np.uint64)
        for block in range(DRAWS // 16):
            rows = np.flatnonzero(longest > 16 * block)
            if len(rows):
                lanes = tb.mix(key[rows, None] + np.arange(4 * block, 4 * block + 4, dtype=np.uint64)).view("<u2") < self.limit
                bits[rows] |= np.packbits(lanes, 1, "little").view("<u2")[:, 0].astype(np.uint64) << np.uint64(16 * block)
        return bits

    def _looked_up(self, words: list[str], length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, candidates skipped) of each occurrence of words of at most ``WIDE`` characters. Node -1: the word, or
        what the occurrence skips, is met for the first time and has none."""
        node = np.fromiter(map(self.root.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(node < 0)
        if len(unknown):
            rare = [words[i] for i in unknown.tolist()]
            seen = Counter(rare)
            new = [w for w, n in seen.items() if n > 1 or w in self.root]
            self.root.update(dict.fromkeys(seen, -1))
            self.root.update(zip(new, self._add(new, np.zeros(len(new), np.uint64)).tolist(), strict=True))
            node[unknown] = np.fromiter(map(self.root.get, rare), np.int64, len(rare))
        bits = self.draws(key, 3 * length - 3)
        rows = np.flatnonzero(node >= 0)
        while len(rows):
            # the first candidate skipped that the agenda sees after those skipped before
            at = node[rows]
            left = bits[rows] & ((np.uint64(1) << self.seen[at]) - np.uint64(1)) & ~self.skipped[at]
            rows, at, left = rows[left > 0], at[left > 0], left[left > 0]
            low = left & (~left + np.uint64(1))
            number = np.log2(low.astype(np.float64)).astype(np.int64)
            down = self.child[at, number]
            if (down < 0).any():
                ways, times = np.unique((at * DRAWS + number)[down < 0], return_counts=True)
                known = self.child[ways // DRAWS, ways % DRAWS] == -2
                self.child[ways // DRAWS, ways % DRAWS] = -2
                new = ways[known | (times > 1)]
                parent, at_number = new // DRAWS, new % DRAWS
                made = self._add([self.word_of[p] for p in parent.tolist()], self.skipped[parent] | np.uint64(1) << at_number.astype(np.uint64))
                self.child[parent, at_number] = made
                down = self.child[at, number]
            node[rows] = np.maximum(down, -1)
            rows = rows[down >= 0]
        return node, bits

    def side_by_side(self, words: list[str], skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each word, candidates seen): agendas advance side by side, one merge each per turn."""
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        flat, count, seen = [np.zeros(0, "<u4")], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            ids, count[own], seen[own], odd = self._agendas([words[i] for i in own.tolist()], skipped[own])
            if len(odd):  # words with characters without a piece
                cut = np.cumsum(count[own])[:-1]
                parts = np.split(ids, cut)
                for r in odd.tolist():
                    bits = int(skipped[own[r]])
                    parts[r], seen[own[r]] = self._one(words[own[r]], lambda number, bits=bits: bits >> number & 1)
                    count[own[r]] = len(parts[r])
                ids = np.concatenate(parts)
            flat.append(ids)
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), "<u4")
        out[_spread(first[order], count[order])] = np.concatenate(flat)
        return out, count, seen

    def _agendas(self, chunks: list[str], skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each word, candidates seen, words that need bytes). Arrays hold place ``row * width + i`` for the
        part of a word that begins at its character ``i``."""
        n, none, gone = len(chunks), -1, -2
        size = np.array([len(c) for c in chunks])
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        known = np.full((n, width), none, np.int32)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        known[inside] = self.letters[np.minimum(points, len(self.letters) - 1)]
        known = known.ravel()
        place = np.arange(n * width)
        end = np.repeat(np.arange(n) * width + size, width)  # of the word of each place
        after, before = np.minimum(place + 1, end), place - 1
        before[::width] = -1
        rank = np.full(n * width, _NONE, np.float32)
        to = np.full(n * width, none, np.int32)
        seen = np.zeros(n, np.int64)
        ranks = rank.reshape(n, width)

        def offer(rows: np.ndarray, at: np.ndarray, first: bool = False) -> None:
            """Candidates of the parts at places ``at`` with the parts after them, one in a row but for the first time."""
            rank[at] = _NONE
            j = after[at]
            ok = np.flatnonzero(j < end[at])
            rows, at = rows[ok], at[ok]
            found = self._pairs(known[at], known[j[ok]])
            ok = np.flatnonzero(found >= 0)
            rows, at, found = rows[ok], at[ok], found[ok]
            number = seen[rows]
            if first:
                number = np.arange(len(rows)) - np.searchsorted(rows, rows)
                np.add.at(seen, rows, 1)
            else:
                seen[rows] += 1
            ok = np.flatnonzero(skipped[rows] >> number.astype(np.uint64) & np.uint64(1) == 0)
            at, found = at[ok], found[ok]
            rank[at] = self.pair_rank[found]
            to[at] = self.pair_to[found]

        offer(*np.divmod(np.flatnonzero(inside), width)[:1], np.flatnonzero(inside), first=True)
        rows = np.arange(n)
        while len(rows):
            at = rows * width + ranks[rows].argmin(1)
            live = np.flatnonzero(rank[at] != _NONE)
            rows, at = rows[live], at[live]
            j = after[at]
            known[at], known[j], rank[j] = to[at], gone, _NONE
            k = after[j]
            after[at] = k
            inner = np.flatnonzero(k < end[at])
            before[k[inner]] = at[inner]
            left = before[at]
            some = np.flatnonzero(left >= 0)
            offer(rows[some], left[some])
            offer(rows, at)
        known = known.reshape(n, width)
        kept = inside & (known != gone)
        plain = (~kept | ((known >= 0) & (known < len(self.size)))).all(1)
        return known[kept].astype("<u4"), kept.sum(1), seen, np.flatnonzero(~plain)

    @classmethod
    def of(cls, *key) -> Pieces:
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(*key)
        return cls._made[key]

    def word(self, chunk: str, key: int) -> np.ndarray:
        """Ids of one word with the spaces before it."""
        return self._one(chunk, lambda number: _mixed((key + number // 4) & _M) >> number % 4 * 16 & 0xFFFF < self.limit)[0]

    def _one(self, chunk: str, skip) -> tuple[np.ndarray, int]:
        """(ids, candidates seen); ``skip`` decides by a candidate's number."""
        parts = list(chunk.replace(SPACE, "\0").replace(" ", SPACE))
        rank, seen = self.rank.get, 0

        def candidate(joined: str) -> float:
            nonlocal seen
            r = rank(joined)
            if r is None:
                return _NONE
            seen += 1
            return _NONE if skip(seen - 1) else r

        if len(parts) > LONG:
            self._merge_long(parts, candidate)
        else:
            self._merge_short(parts, candidate)
        ids: list[int] = []
        for p in parts:
            ids += [self.id[p]] if p in self.id else [self.byte[x] for x in (SPACE if p == "\0" else p).encode()]
        return np.array(ids, "<u4"), seen

    @staticmethod
    def _merge_short(parts: list[str], candidate) -> None:
        """The agenda as a list of the candidates in place: its scans are short."""
        agenda = [candidate(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda and (best := min(agenda)) != _NONE:
            i = agenda.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], agenda[i]
            if i:
                agenda[i - 1] = candidate(parts[i - 1] + parts[i])
            if i < len(agenda):
                agenda[i] = candidate(parts[i] + parts[i + 1])

    @staticmethod
    def _merge_long(parts: list[str], candidate) -> None:
        """The agenda as a heap over linked parts, for words of thousands of characters."""
        n = len(parts)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := candidate(parts[i] + parts[j])) != _NONE:
                heapq.heappush(agenda, (r, i, ends[i], ends[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, mid, end = heapq.heappop(agenda)
            if not parts[i] or ends[i] != mid or after[i] >= n or ends[after[i]] != end:
                continue  # one of its parts has been merged
            j = after[i]
            parts[i] += parts[j]
            parts[j], ends[i], after[i] = "", end, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        parts[:] = [p for p in parts if p]

    def encode(self, text: str, doc: int = 0) -> bytes:
        return self.encode_many([text], [doc])[0].tobytes()

    def encode_many(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Ids of texts, their words looked up so many at a time, whatever the texts' lengths."""
        out: list[np.ndarray] = []
        words: list[str] = []
        cuts = [0]
        keys = []
        for text, doc in zip(texts, docs, strict=True):
            own = CHUNK.findall(" " + text) if text else []
            words += own
            cuts.append(len(words))
            keys.append(word_keys(self.seed, doc, len(own)))
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), AT_ONCE):
            found, size = self._encoded(words[at : at + AT_ONCE], key[at : at + AT_ONCE])
            ids.append(found)
            sizes.append(size)
        flat = np.concatenate(ids)
        edges = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))[cuts]
        out += [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return out

    def _encoded(self, words: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word)."""
        if self.nodes > self.remember or len(self.root) > 4 * self.remember:
            self._forget()
        length = np.fromiter(map(len, words), np.int64, len(words))
        wide = length <= WIDE
        small = np.flatnonzero(wide)
        short = words if len(small) == len(words) else [words[i] for i in small.tolist()]
        node, bits = self._looked_up(short, length[small], key[small])
        fresh = small[node < 0]
        made, made_size, _ = self.side_by_side([words[i] for i in fresh.tolist()], bits[node < 0])
        large = [self.word(words[i], int(key[i])) for i in np.flatnonzero(~wide).tolist()]
        size = np.zeros(len(words), np.int64)
        size[small[node >= 0]], size[fresh], size[~wide] = self.count[node[node >= 0]], made_size, [len(x) for x in large]
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<u4")
        known = small[node >= 0]
        out[_spread(first[known], size[known])] = self.ids[_spread(self.first[node[node >= 0]], size[known])]
        out[_spread(first[fresh], size[fresh])] = made
        if large:
            out[_spread(first[~wide], size[~wide])] = np.concatenate(large)
        return out, size

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text's bytes after the space that encoding puts first."""
        return self.flat[_spread(self.at[ids], self.size[ids])].tobytes()[1:]

    def decode(self, ids: bytes) -> str:
        return self.decoded(np.frombuffer(ids, "<u4")).decode()


def _encoding(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path, dropout, seed)
        for batch in tb.chunks(batches):
            texts = tb.column(batch, "text").to_pylist()
            filled = [r for r, t in enumerate(texts) if t is not None]
            docs = [d or 0 for d in tb.column(batch, "doc_id").to_pylist()]
            ids: list[bytes | None] = [None] * len(texts)
            same = [True] * len(texts)
            for r, got in zip(filled, model.encode_many([texts[r] for r in filled], [docs[r] for r in filled]), strict=True):
                ids[r], same[r] = got.tobytes(), model.decoded(got) == texts[r].encode()
            yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), pa.array(ids, pa.binary()), pa.array(same)], ["doc_id", "ids", "lossless"])

    return run


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, ids, lossless): little-endian 32-bit ids, and whether they decode to the very text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoding(model, dropout, seed), "doc_id long, ids binary, lossless boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in tb.column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([tb.column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
