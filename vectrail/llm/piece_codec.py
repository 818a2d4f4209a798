"""SentencePiece encoding with seeded merge-dropout, and its decoding.

A merge-type model joins adjacent symbols, best score first, leftmost on ties.
With dropout every candidate merge that comes up is skipped with probability
``dropout``, decided by a keyed hash of the seed, the document, the number of
the word in it and the candidate's place in the word, so each occurrence of a
word has draws of its own and a run can be repeated exactly. Every choice
spells the same characters, so decoding gives the text back whatever was
skipped; characters that the vocabulary lacks are spelt as bytes.

Pieces never cross from one word into the next, so words are segmented one by
one. The segmentation without dropout is kept per word, with the merges it
takes. An occurrence that skips none of those comes to the same result: merges
that are never taken can be skipped without effect. Only the others are
segmented anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7

SPACE = "▁"
_LITERAL = "\udc00"  # stands for a SPACE character of the text itself; no valid text holds it
_CHUNK_CHARS = 1_000_000
_CACHE_WORDS = 400_000
_LONG_WORD = 48
_COLUMNS = 8192
_NONE = np.iinfo(np.int64).min  # an empty slot; no pair of symbols, -1 included, has this key
_GONE = -2  # a symbol that a merge took in


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``byte_id[b]`` is the piece of byte b."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_id: list[int]


def load(model: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    normal = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
    place = {p: i for i, p in enumerate(pieces) if m.is_byte(i)}
    if len(place) != 256:
        raise ValueError("the model must have all 256 byte pieces, else not every text can be given back")
    return Vocabulary(pieces, [m.get_score(i) for i in range(n)], normal, [place[f"<0x{b:02X}>"] for b in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_M = 0xFFFFFFFFFFFFFFFF


def _mix_int(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


class _Numbers(dict[str, int]):
    """Words numbered in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass(frozen=True)
class _Runs:
    """Runs of ``flat``, ``count[i]`` values from ``begin[i]`` on."""

    flat: np.ndarray
    begin: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, count: np.ndarray) -> _Runs:
        return cls(flat, np.cumsum(count) - count, count)

    def then(self, other: _Runs) -> _Runs:
        return _Runs(np.concatenate([self.flat, other.flat]), np.concatenate([self.begin, other.begin + len(self.flat)]), np.concatenate([self.count, other.count]))

    def values(self, which: np.ndarray) -> np.ndarray:
        """The values of some runs, one run after the other."""
        begin, count = self.begin[which], self.count[which]
        ends = np.cumsum(count)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)]


@dataclass(frozen=True)
class _Words:
    """Words with their characters in ``points``, from ``first`` on, ``size`` of them with the SPACE in front."""

    words: list[str]
    points: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> _Words:
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return cls(words, points, np.cumsum(size) - size, size)


@dataclass
class Codec:
    vocabulary: Vocabulary
    dropout: float = DROPOUT
    seed: int = SEED

    def __post_init__(self) -> None:
        v = self.vocabulary
        if len(v.pieces) >> 21:
            raise ValueError("pairs of pieces are packed in 21 bits each")
        self.id_of = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
        by_rank = sorted((i for i in range(len(v.pieces)) if v.normal[i]), key=lambda i: (-v.scores[i], i))
        self.rank = np.full(len(v.pieces), 1 << 30, np.int64)
        self.rank[by_rank] = np.arange(len(by_rank))
        self.by_rank = np.array(by_rank, np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_rank = np.where(self.char_id >= 0, self.rank[self.char_id], -1).astype(np.int32)
        pairs: dict[tuple[int, int], int] = {}
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        made = np.array([(a, b, m) for (a, b), m in pairs.items()], np.int64).reshape(-1, 3)
        left, right, whole = self.rank[made].T
        held = left << 21 | right
        order = np.argsort(held)
        self.pair_keys, self.pair_made = held[order], whole[order]
        slot = self._slots(self.pair_keys)
        self.table = np.full(1 << 19, _NONE, np.int64)
        self.table[slot] = self.pair_keys << 21 | self.pair_made  # of pairs in one slot the last holds it
        self.crowded = np.zeros(1 << 19, bool)
        self.crowded[slot[self.table[slot] >> 21 != self.pair_keys]] = True
        grid = np.arange(64, dtype=np.uint64)
        self.mixed = _mix(self._place(grid[:, None, None], grid[:, None], grid)).ravel()
        self.spell = pa.array(self._spelling(), pa.binary())
        self.limit = int(self.dropout * 2.0**64) if self.dropout < 1 else _M
        self._forget()

    def _forget(self) -> None:
        """Start afresh with no word known."""
        self.number = _Numbers()
        none = np.zeros(0, np.int64)
        self.known = _Runs(np.zeros(0, np.int32), none, none)
        self.taken = _Runs(np.zeros(0, np.uint64), none, none)  # places of the merges taken, mixed

    def _spelling(self) -> list[bytes]:
        v = self.vocabulary
        spell = [p.replace(SPACE, " ").encode() if v.normal[i] else b"" for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_id):
            spell[i] = bytes([b])
        return spell

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).view(np.int64)

    @staticmethod
    def _place(start: np.ndarray, mid: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return start.astype(np.uint64) << np.uint64(42) | mid.astype(np.uint64) << np.uint64(21) | stop.astype(np.uint64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two adjacent ones, given by rank, make; -1 for none."""
        keys = left.astype(np.int64) << 21 | right
        slot = self._slots(keys)
        held = self.table[slot]
        ok = held >> 21 == keys
        out = np.where(ok, held & 0x1FFFFF, -1)
        lost = np.flatnonzero(~ok & self.crowded[slot])
        if len(lost):
            i = np.minimum(np.searchsorted(self.pair_keys, keys[lost]), len(self.pair_keys) - 1)
            out[lost] = np.where(self.pair_keys[i] == keys[lost], self.pair_made[i], -1)
        return out

    def occurrence_keys(self, document: int, n: int) -> np.ndarray:
        """A key for each of the ``n`` words of a document; ``document`` is a hash of its own."""
        return self._all_keys([document], [n])

    def _all_keys(self, documents: list[int], sizes: list[int]) -> np.ndarray:
        seed = _mix_int(self.seed & _M)
        size = np.array(sizes, np.int64)
        own = np.array([(d ^ seed) & _M for d in documents], np.uint64)
        nth = np.arange(1, size.sum() + 1) - np.repeat(np.cumsum(size) - size, size)
        return _mix(np.repeat(own, size) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _spelt(self, symbol: int, char: str) -> list[int]:
        if symbol >= 0:
            return [symbol]
        return [self.vocabulary.byte_id[b] for b in (SPACE if char == _LITERAL else char).encode("utf-8", "surrogatepass")]

    def agenda(self, word: str, key: int | None) -> tuple[list[int], list[int]]:
        """Segmentation of one word by a priority queue and the places of the merges taken; without ``key`` none is skipped."""
        ids = [int(self.char_id[ord(c)]) for c in word]
        n = len(word)
        stop, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int, int]] = []
        taken: list[int] = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= n or ids[a] < 0 or ids[b] < 0:
                return
            made = self.pairs.get((ids[a], ids[b]))
            if made is None:
                return
            if key is not None and _mix_int(key ^ _mix_int((a << 42 | b << 21 | stop[b]) & _M)) < self.limit:
                return
            heapq.heappush(queue, (int(self.rank[made]), a, b, stop[b], made))

        for i in range(n):
            offer(i)
        dead = [False] * n
        while queue:
            _, a, b, end, made = heapq.heappop(queue)
            if dead[a] or dead[b] or after[a] != b or stop[b] != end or stop[a] != b:
                continue
            taken.append((a << 42 | b << 21 | end) & _M)
            ids[a], stop[a], after[a] = made, end, after[b]
            dead[b] = True
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [x for i in range(n) if not dead[i] for x in self._spelt(ids[i], word[i])], taken

    def batch(self, words: list[str], keys: np.ndarray | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Segmentations (int32 little-endian) of many words at once, what :meth:`agenda` gives for each.

        Also, without ``keys``, the places of the merges taken, in the order of
        the words, and where each word's begin.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        pieces, taken = self._rounds(points, np.cumsum(size) - size, size, keys)
        ids = [pieces.flat[a : a + n].tobytes() for a, n in zip(pieces.begin.tolist(), pieces.count.tolist())]
        return ids, taken.values(np.arange(len(words))), np.append(0, np.cumsum(taken.count))

    def _rounds(self, points: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray | None) -> tuple[_Runs, _Runs]:
        """Pieces of many words and, without ``keys``, the places of the merges taken. Words of about the same size go together."""
        n = len(size)
        order = np.argsort(size, kind="stable")
        ranked = size[order]
        pieces, counts, taken, merges = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        at = 0
        while at < n:
            upto = int(np.searchsorted(ranked, ranked[at] + 1 + ranked[at] // 4, "right"))
            upto = min(upto, at + _COLUMNS)
            some = order[at:upto]
            p, c, t, m = self._block(points, first[some], size[some], None if keys is None else keys[some])
            pieces.append(p)
            counts.append(c)
            taken.append(t)
            merges.append(m)
            at = upto
        out = []
        for flat, count in ((pieces, counts), (taken, merges)):
            runs = _Runs.of(np.concatenate(flat), np.concatenate(count))
            begin, number = np.empty(n, np.int64), np.empty(n, np.int64)
            begin[order], number[order] = runs.begin, runs.count
            out.append(_Runs(runs.flat, begin, number))
        return out[0], out[1]

    def _block(self, points: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces and their number for each word, merges taken and theirs.

        A word is a column with a row per character and an empty one below. A
        symbol stays in the row of its first character; ``cost`` orders its
        merge with the next one. A round takes the best merge of every word.
        """
        n, rows = len(size), int(size.max())
        bits = rows.bit_length()
        kind = np.int32 if len(self.by_rank) << bits < 1 << 31 else np.int64
        none, low = np.iinfo(kind).max, (1 << bits) - 1
        row = np.arange(rows + 1)[:, None]
        inside = row < size
        chars = points[np.where(inside, first + row, 0)]
        symbol = np.where(inside, self.char_rank[chars], -1).ravel()
        after = np.repeat(np.arange(1, rows + 2), n)
        before = np.repeat(np.arange(-1, rows), n)
        limit = np.uint64(self.limit)

        def offers(left: np.ndarray, right: np.ndarray, start: np.ndarray, mid: np.ndarray, stop: np.ndarray, column: np.ndarray) -> np.ndarray:
            made = self._merged(left, right)
            found = np.flatnonzero(made >= 0)
            out = np.full(len(made), none, kind)
            if keys is not None:
                a, b, c = start[found], mid[found], stop[found]
                mixed = self.mixed[a << 12 | b << 6 | c] if rows < 64 else _mix(self._place(a, b, c))
                found = found[_mix(keys[column[found]] ^ mixed) >= limit]
            out[found] = made[found] << bits | start[found]
            return out

        cells = rows * n
        cost = np.full(cells + n, none, kind)
        near = np.flatnonzero((symbol[:-n] >= 0) & (symbol[n:] >= 0))
        start = near // n
        cost[near] = offers(symbol[near], symbol[near + n], start, start + 1, start + 2, near - start * n)
        grid = cost.reshape(rows + 1, n)
        took = []
        while True:
            best = grid.min(axis=0)
            column = np.flatnonzero(best != none)
            if not len(column):
                break
            best = best[column].astype(np.int64)
            start, made = best & low, best >> bits
            at = start * n + column
            mid = after[at]
            gone = mid * n + column
            stop = after[gone]
            behind = stop * n + column
            symbol[at], symbol[gone] = made, _GONE
            after[at], before[behind] = stop, start
            cost[gone] = none
            front = before[at]  # -1 is the empty row
            ahead = front * n + column
            new = offers(
                np.concatenate([made, symbol[ahead]]),
                np.concatenate([symbol[behind], made]),
                np.concatenate([start, front]),
                np.concatenate([stop, start]),
                np.concatenate([after[behind], stop]),
                np.concatenate([column, column]),
            )
            cost[at], cost[ahead] = new[: len(at)], new[len(at) :]
            if keys is None:
                took.append((column, self._place(start, mid, stop)))
        merges = np.zeros((n, len(took)), np.uint64)
        for i, (column, place) in enumerate(took):
            merges[column, i] = place
        stays = (inside & (symbol.reshape(rows + 1, n) != _GONE)).T
        ranks = symbol.reshape(rows + 1, n).T[stays]
        count = stays.sum(axis=1)
        pieces = self.by_rank[ranks]
        if (ranks < 0).any():
            pieces, count = self._with_bytes(pieces, count, np.where(ranks < 0, chars.T[stays], 0), ranks < 0)
        return pieces, count, merges[merges != 0], (merges != 0).sum(axis=1)

    def _with_bytes(self, pieces: np.ndarray, count: np.ndarray, chars: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pieces`` with the UTF-8 bytes of ``chars`` for those that are ``unknown``."""
        chars = np.where(chars == ord(_LITERAL), ord(SPACE), chars).astype(np.int64)
        length = np.where(unknown, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1)
        source = np.repeat(np.arange(len(pieces)), length)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(length) - length, length)
        n = length[source]
        part = chars[source] >> 6 * (n - 1 - nth)
        lead = np.where(n == 1, part, (0xF00 >> n) & 0xFF | part)
        byte = np.where(nth == 0, lead, 0x80 | part & 0x3F)
        out = np.where(unknown[source], np.array(self.vocabulary.byte_id, np.int32)[byte & 0xFF], pieces[source])
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(count))]
        return out, np.diff(ends)

    def _segment(self, w: _Words, which: np.ndarray, keys: np.ndarray | None) -> tuple[_Runs, _Runs, np.ndarray]:
        """Pieces and merges taken of the words ``which``, and the order that they come in: long ones last, by the agenda."""
        far = w.size[which] > _LONG_WORD + 1
        near, long = np.flatnonzero(~far), np.flatnonzero(far)
        pieces, taken = self._rounds(w.points, w.first[which[near]], w.size[which[near]], None if keys is None else keys[near])
        slow = [self.agenda(SPACE + w.words[which[i]], None if keys is None else int(keys[i])) for i in long.tolist()]
        if slow:
            pieces = pieces.then(_Runs.of(np.array([x for ids, _ in slow for x in ids], np.int32), np.array([len(ids) for ids, _ in slow], np.int64)))
            taken = taken.then(_Runs.of(np.array([x for _, t in slow for x in t], np.uint64), np.array([len(t) for _, t in slow], np.int64)))
        return pieces, taken, np.concatenate([near, long])

    @staticmethod
    def units(text: str) -> list[str]:
        """Words of a text, each to be read with one SPACE in front; further spaces stay part of the word."""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for i, p in enumerate(parts):
            if p or i == len(parts) - 1:
                out.append(SPACE * run + p)
                run = 0
            else:
                run += 1
        return out

    def _look_up(self, w: _Words) -> np.ndarray:
        """The number of each word; the segmentations of new ones without dropout are kept, with the merges they take."""
        at = np.fromiter(map(self.number.__getitem__, w.words), np.int64, len(w.words))
        if len(self.number) > _CACHE_WORDS and len(self.known.count):
            self._forget()
            at = np.fromiter(map(self.number.__getitem__, w.words), np.int64, len(w.words))
        old = len(self.known.count)
        if len(self.number) > old:
            new = np.flatnonzero(at >= old)
            one = np.empty(len(self.number) - old, np.int64)  # a place where each new word is
            one[at[new] - old] = new
            pieces, taken, order = self._segment(w, one, None)
            back = np.argsort(order)
            self.known = self.known.then(_Runs(pieces.flat, pieces.begin[back], pieces.count[back]))
            self.taken = self.taken.then(_Runs(_mix(taken.flat), taken.begin[back], taken.count[back]))
        return at

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Piece ids of each text as int32 bytes; ``keys`` are hashes that tell documents apart."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= _CHUNK_CHARS):
                chars += len(texts[stop])
                stop += 1
            out += self._chunk(texts[at:stop], keys[at:stop])
            at = stop
        return out

    def _chunk(self, texts: list[str], keys: list[int]) -> list[bytes]:
        docs = [self.units(t) if t else [] for t in texts]
        sizes = [len(d) for d in docs]
        if not any(sizes):
            return [b""] * len(texts)
        w = _Words.of([u for d in docs for u in d])
        at = self._look_up(w)
        runs = self.known
        if self.limit:
            own = self._all_keys(keys, sizes)
            count = self.taken.count[at]
            skipped = _mix(np.repeat(own, count) ^ self.taken.values(at)) < np.uint64(self.limit)
            skips = np.zeros(len(at), bool)
            skips[np.repeat(np.arange(len(at)), count)[skipped]] = True
            again = np.flatnonzero(skips)
            pieces, _, order = self._segment(w, again, own[again])
            at[again[order]] = len(runs.count) + np.arange(len(again))
            runs = runs.then(pieces)
        ids = runs.values(at)
        ends = (np.append(0, np.cumsum(runs.count[at]))[np.append(0, np.cumsum(sizes))] * 4).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes | np.ndarray | list[int]) -> str:
        numbers = np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else np.asarray(ids, np.int32)
        if not len(numbers):
            return ""
        spelt = self.spell.take(pa.array(numbers))
        _, ends, data = spelt.buffers()
        size = np.frombuffer(ends, np.int32, len(numbers) + 1)[-1]
        return str(memoryview(data)[:size], "utf-8", "surrogatepass")[1:]


_CODECS: dict[tuple[int, float, int], Codec] = {}


def _codec(vocabulary: Vocabulary, dropout: float, seed: int) -> Codec:
    key = (hash(tuple(vocabulary.pieces)), dropout, seed)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, dropout, seed)
    return _CODECS[key]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``ids``, ``n_pieces`` and ``lossless`` (decoding ``ids`` gave the text back).

    A null text has null ``ids`` and ``lossless`` and no pieces, '' has empty
    ``ids``. Texts are encoded whole: spaces at the ends, runs of spaces, line
    breaks and any character survive. Rows with equal ids and texts are encoded
    alike; a null id is an id. With ``dropout`` 0 the result is the model's own
    segmentation. Extra columns are not read; an empty table gives an empty
    result. The vocabulary, whose size is fixed, is broadcast; nothing is shuffled.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))
    kind = docs.schema[doc_id].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, dropout, seed)
        for batch in it:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            made = codec.encode([t or "" for t in texts], keys)
            sizes = [len(m) // 4 for m in made]
            null = np.array([t is None for t in texts], bool)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False)) if len(texts) else pa.array([0], pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(made), np.int32)))
            right = [None if t is None else codec.decode(m) == t for t, m in zip(texts, made)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), ids, pa.array(sizes, pa.int32()), pa.array(right, pa.bool_())], ["doc", "ids", "n_pieces", "lossless"])

    keyed = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("key"))
    return keyed.mapInArrow(batches, f"doc {kind}, ids array<int>, n_pieces int, lossless boolean").withColumnRenamed("doc", doc_id)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` from piece ids: the text that was encoded, whatever was skipped.

    Null ids give null, empty ones ''. Rows stay as they are, repeated ones and
    null ``doc_id`` too; other columns are not read; an empty table gives an
    empty result.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(model))
    kind = encoded.schema[doc_id].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, 0.0, 0)
        for batch in it:
            texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return encoded.select(F.col(doc_id).alias("doc"), F.col(ids).alias("ids")).mapInArrow(batches, f"doc {kind}, text string").withColumnRenamed("doc", doc_id)
