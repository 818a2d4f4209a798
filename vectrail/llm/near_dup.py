"""Near-duplicate documents by an exact containment join.

Documents are sets of word shingles. A document is near another that isn't
smaller if at least ``threshold`` of its shingles are in it, whatever the sizes
of both. All such pairs are found:

* Shingles are dealt to buckets by their hash, and those of one text only are
  dropped there. What is left is dealt to buckets by text, which puts each
  text's shared shingles in order, those in fewest texts first.
* A text that is near another shares one of the first ``size - overlap + 1`` of
  its shingles with it, where ``overlap`` is the number that reaches the
  threshold. Those of them that are shared are what it asks with. Most texts
  have more shingles of their own than that, and ask with none.
* Shared shingles meet again by bucket; what holds one that another asks with
  is a candidate. Candidates are compared by their shared shingles, which is
  exact: a shingle that both hold is shared.

Documents of comparable size (up to ``1 / threshold`` times) that near
duplicates link, directly or over others, are a group; the foremost stays
(texts with more exact copies first, then larger ones, then smaller ids). Where
one of a group is contained in a far larger document, the group goes too, in
favour of that document's.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import joined, materialise, release, sweep

SHINGLE = 3
THRESHOLD = 0.7
#: Shingles from which on a document is looked for in far larger ones; all are.
QUOTE = 1
#: Shingles that a task deals at once, and those of a bucket (some 16 bytes each, held about five times over).
DEALT, BUCKET = 1_000_000, 2_000_000
#: Bytes of text for a shingle, to tell the number of buckets.
BYTES_A_SHINGLE = 6
#: Parts of the shingles that are dealt one after the other; every one reads the texts again.
PASSES = 2
#: Shared shingles that meet their candidates at once.
BLOCK = 4_000_000
#: Rows of a table that a join sends to all executors instead of moving the other side (some 50 bytes each).
BESIDE = 1_000_000
#: Pairs of postings that a task looks at at once.
EXPANDED = 500_000
#: Remainders of shingles that rule out most pairs; they fit into 16 bits.
REMAINDERS = 32_749
#: Holders of a shingle that are first tried as far larger documents.
FIRST = 4
#: Words whose hashes a task remembers, and places for those of up to 16 bytes in arrays.
KNOWN_WORDS, PLACES = 200_000, 1 << 18
#: Bytes of text whose words are told at once.
TEXT_AT_ONCE = 1 << 20

_WORDY = {*range(48, 58), *range(97, 123), 95, *range(128, 256)}
_SPACED = bytes(b if b in _WORDY else 32 for b in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = made
        return made


_known = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Table:
    """The hashes of words of up to 16 bytes, looked up for many at once; a word's bytes, two numbers, are its key. Each place holds two words: the first that came, as most common ones do, and the newest."""

    def __init__(self) -> None:
        self.low, self.high, self.hash = (np.zeros((2, PLACES), np.uint64) for _ in range(3))

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        place = ((low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (PLACES.bit_length() - 1))
        out = self.hash[0][place]
        lacking = np.flatnonzero((self.low[0][place] != low) | (self.high[0][place] != high))
        at = place[lacking]
        out[lacking] = self.hash[1][at]
        lacking = lacking[(self.low[1][at] != low[lacking]) | (self.high[1][at] != high[lacking])]
        if len(lacking):
            order = lacking[np.lexsort((low[lacking], high[lacking]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            first = order[new]
            words = map(bytes, np.stack([low[first], high[first]], 1))
            made = np.array([xxhash.xxh3_64_intdigest(w.rstrip(b"\0")) for w in words], np.uint64)
            out[order] = made[np.cumsum(new) - 1]
            at, single = np.unique(place[first], return_index=True)  # of several that belong in one place, one is kept
            way = ((self.low[0][at] | self.high[0][at]) != 0).astype(np.int64)
            for held, now in ((self.low, low[first]), (self.high, high[first]), (self.hash, made)):
                held[way, at] = now[single]
        return out


_table = _Table()
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _told(texts: list[str | None]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """For each text what :func:`content_of` gives for its words, or None without any, and where its words end; and the hashes of all their words."""
    parts = [b" %s " % (t or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED) for t in texts]
    held = b"".join(parts) + bytes(16)
    raw = np.frombuffer(held, np.uint8)
    text = raw[:-16]
    inside = text != 32
    start = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    end = np.flatnonzero(inside[1:] < inside[:-1]) + 1
    size = end - start
    eight = np.ndarray((len(raw) - 8,), "<u8", held, 0, (1,))
    low = eight[start] & _MASKS[np.minimum(size, 8)]
    high = np.zeros(len(start), np.uint64)
    long = np.flatnonzero(size > 8)
    high[long] = eight[start[long] + 8] & _MASKS[np.minimum(size[long] - 8, 8)]
    hashes = _table.hashes(low, high)
    for i in np.flatnonzero(size > 16).tolist():
        hashes[i] = _known[held[start[i] : end[i]]]
    ends = np.searchsorted(start, np.cumsum(list(map(len, parts))))
    # a word and the space after it are what stays of a text, but for the last space
    keep = inside.copy()
    keep[end] = True
    packed = text[keep].tobytes()
    upto = np.append(0, np.cumsum(size + 1))[np.append(0, ends)].tolist()
    nums = []
    for a, b in zip(upto, upto[1:]):
        made = xxhash.xxh3_64_intdigest(packed[a : b - 1]) if b > a else None
        nums.append(made - (1 << 64) if made is not None and made >> 63 else made)
    return nums, ends, hashes


def told(texts: list[str | None], most: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(what :func:`content_of` gives, hashes of the words) of each text, as many at once as have ``most`` characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < (most or TEXT_AT_ONCE)):
            size += len(texts[to] or "")
            to += 1
        nums, ends, hashes = _told(texts[at:to])
        yield from zip(nums, np.split(hashes, ends[:-1]))
        at = to


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits, ``_`` and anything beyond ASCII, in lower case."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def content_of(words: list[bytes]) -> int:
    """What stands for a text: equal for texts of the same words."""
    made = xxhash.xxh3_64_intdigest(b" ".join(words))
    return made - (1 << 64) if made >> 63 else made


def shingles_of(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes. Fewer words than ``width`` are one shingle, no words none."""
    return _shingled(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)), width)


def _shingled(hashes: np.ndarray, width: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = min(width, len(hashes))
    acc = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i])
    acc.sort()
    return acc[np.flatnonzero(np.diff(acc, prepend=~acc[:1]))]


def shingle_set(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, list[bytes]]:
    words = words_of(text)
    return shingles_of(words, width), words


def least_overlap(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def asked(size: int, shared: int, threshold: float) -> int:
    """With how many of its ``shared`` shingles, those in fewest texts first, a text of ``size`` must ask to meet all that it is near to."""
    return max(0, size - least_overlap(size, threshold) + 1 - (size - shared))


_POSTINGS = "bucket int, nums binary, counts binary, keys binary, extra binary"


def _place(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: those that a bucket's values have in common are next to each other and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(column: pa.ChunkedArray, kind: type | np.dtype) -> np.ndarray:
    width = np.dtype(kind).itemsize
    made = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel() for x in column.to_pylist()]
    return np.concatenate(made) if made else np.zeros(0, kind)


def _deal(place: np.ndarray, nums: np.ndarray, keys: np.ndarray, extra: np.ndarray | None) -> pa.RecordBatch:
    """A row per bucket with its postings; ``place`` is in order, and a run of one text in a bucket has its number once."""
    start = np.ones(len(place), bool)
    start[1:] = (place[1:] != place[:-1]) | (nums[1:] != nums[:-1])
    runs = np.flatnonzero(start)
    along = np.arange(len(place)) - np.repeat(runs, np.diff(runs, append=len(place)))
    runs = np.flatnonzero(along % 255 == 0)  # a count is one byte
    counts = np.diff(runs, append=len(place)).astype(np.uint8)
    edges = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1, append=1 << 40))
    heads = np.searchsorted(runs, edges)
    pick = nums[runs]
    cut = lambda x, ends, put=np.ndarray.tobytes: pa.array([put(x[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
    more = cut(extra, edges) if extra is not None else pa.array([b""] * (len(edges) - 1), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(place[edges[:-1]].astype(np.int32)), cut(pick, heads, _planes), cut(counts, heads), cut(keys, edges, _planes), more], ["bucket", "nums", "counts", "keys", "extra"])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _empty(schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([], schema)


def _sized(docs: DataFrame, buckets: int, width: int, part: int) -> DataFrame:
    """Postings of every PASSES-th bucket's shingles by bucket; in the first part, rows without counts hold numbers of texts and, as ``extra``, their sizes, by bucket of the text."""

    def made(nums: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(nums.view(np.uint64))
        nums, sets = nums[order], [sets[i] for i in order]
        sizes = np.array([len(x) for x in sets], np.int64)
        keys, owner = np.concatenate(sets), np.repeat(nums, sizes)
        place = _place(keys, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        here = np.flatnonzero(place % PASSES == part)
        order = here[np.argsort(place[here], kind="stable")]
        if len(order):
            yield _deal(place[order], owner[order], keys[order], None)
        if part:
            return
        told = _deal(_place(nums, buckets), nums, nums, sizes)
        bare = pa.array([b""] * len(told), pa.binary())
        yield pa.RecordBatch.from_arrays([told.column(0), told.column(3), bare, bare, told.column(4)], told.schema.names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        total = 0
        for batch in it:
            for num, hashes in told(batch.column("text").to_pylist()):
                if num is None or num in sets:
                    continue
                sets[num] = _shingled(hashes, width)
                total += len(sets[num])
                if total >= DEALT:
                    yield from made(np.array(list(sets), np.int64), list(sets.values()))
                    sets, total = {}, 0
        if sets:
            yield from made(np.array(list(sets), np.int64), list(sets.values()))

    return docs.select("text").mapInArrow(batches, _POSTINGS)


def _shared(table: pa.Table, buckets: int) -> pa.Table:
    """The postings of one bucket that more than one text has, with the number of texts as ``extra``, by bucket of the text."""
    told = np.array([not c for c in table.column("counts").to_pylist()], bool)
    sizes = table.filter(pa.array(told))
    mine = table.filter(pa.array(~told))
    out = [sizes]
    if len(mine):
        nums = np.repeat(_whole(mine.column("nums"), np.int64), _joined(mine.column("counts"), np.uint8))
        keys = _whole(mine.column("keys"), np.uint64)
        order = np.argsort(keys)
        keys, nums = keys[order], nums[order]
        twice = np.zeros(len(keys), bool)
        twice[1:] = keys[1:] == keys[:-1]
        twice[:-1] |= twice[1:]
        keys, nums = keys[twice], nums[twice]
        order = np.lexsort((nums, keys))  # the same text may come from many tasks
        keys, nums = keys[order], nums[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (nums[1:] != nums[:-1])
        keys, nums = keys[once], nums[once]
        runs = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        n = np.diff(runs, append=len(keys))
        n = np.repeat(n, n)
        keys, nums, n = keys[n > 1], nums[n > 1], n[n > 1]
        if len(keys):
            order = np.argsort(nums.view(np.uint64), kind="stable")
            keys, nums = keys[order], nums[order]
            out.append(pa.Table.from_batches([_deal(_place(nums, buckets), nums, keys, np.minimum(n[order], 65535).astype(np.uint16))]).cast(table.schema))
    return pa.concat_tables(out)


def _lists(table: pa.Table, threshold: float) -> pa.Table:
    """(num, size, asks, keys) of the texts of one bucket that share shingles; those in fewest texts first."""
    told = np.array([not c for c in table.column("counts").to_pylist()], bool)
    sizes, mine = table.filter(pa.array(told)), table.filter(pa.array(~told))
    schema = pa.schema([("num", pa.int64()), ("size", pa.int32()), ("asks", pa.int32()), ("keys", pa.list_(pa.int64()))])
    if not len(mine):
        return _empty(schema)
    all_nums, first = np.unique(_whole(sizes.column("nums"), np.int64), return_index=True)
    all_sizes = _joined(sizes.column("extra"), np.int64)[first]
    nums = np.repeat(_whole(mine.column("nums"), np.int64), _joined(mine.column("counts"), np.uint8))
    keys, n = _whole(mine.column("keys"), np.int64), _joined(mine.column("extra"), np.uint16)
    order = np.lexsort((keys, n, nums))
    nums, keys = nums[order], keys[order]
    runs = np.flatnonzero(np.diff(nums, prepend=~nums[:1]))
    held = np.diff(runs, append=len(nums))
    size = all_sizes[np.searchsorted(all_nums, nums[runs])]
    asks = [asked(s, m, threshold) for s, m in zip(size.tolist(), held.tolist())]
    offsets = np.append(runs, len(nums)).astype(np.int32)
    return pa.Table.from_arrays([pa.array(nums[runs]), pa.array(size.astype(np.int32)), pa.array(asks, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], schema=schema)


def _shared_lists(docs: DataFrame, buckets: int, threshold: float, width: int) -> DataFrame:
    """(num, size, asks, keys) of all texts that share shingles.

    All shingles at once would take more disk than all that follows: a part of
    the buckets is dealt at a time, and what is shared of it is written before
    the next.
    """
    parts = []
    for part in range(PASSES):
        parts.append(materialise(_sized(docs, buckets, width, part).groupBy("bucket").applyInArrow(lambda t: _shared(t, buckets), _POSTINGS), "shared"))
        sweep(docs.sparkSession)
    shared = functools.reduce(DataFrame.unionByName, parts)
    lists = []
    for part in range(PASSES):
        lists.append(materialise(shared.where(F.col("bucket") % PASSES == part).groupBy("bucket").applyInArrow(lambda t: _lists(t, threshold), "num bigint, size int, asks int, keys array<bigint>"), "lists"))
        sweep(docs.sparkSession)
    release(*parts)
    return joined(*lists)


_WHO = np.dtype([("num", np.int64), ("size", np.int32)])


def _bands(keys: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """For each posting the place of the largest of its key that it is of comparable size with; postings are in order of key, the larger first."""
    hub = np.full(len(keys), -1)
    left = np.arange(len(keys))
    while len(left):
        runs = np.flatnonzero(np.diff(keys[left], prepend=~keys[left[:1]]))
        top = np.repeat(left[runs], np.diff(runs, append=len(left)))
        close = sizes[left] >= threshold * sizes[top] - 1e-9
        hub[left[close]] = top[close]
        left = left[~close]
    return hub


def _met(lists: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """(bucket, key, num, size, asked, n, o_num, o_size) of all shared shingles that a text asks with; ``n`` texts hold one.

    The other is the largest text of comparable size that holds the shingle, if the smaller of both asks with it.
    """

    def out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not len(batch):
                continue
            column = batch.column("keys")
            held = np.diff(column.offsets.to_numpy())
            who = np.zeros(len(batch), _WHO)
            who["num"], who["size"] = batch.column("num").to_numpy(), batch.column("size").to_numpy()
            keys = column.flatten().to_numpy()
            along = np.arange(len(keys)) - np.repeat(np.cumsum(held) - held, held)
            asks = (along < np.repeat(batch.column("asks").to_numpy(), held)).astype(np.uint8)
            place = _place(keys, buckets)
            order = np.argsort(place, kind="stable")
            yield _deal(place[order], np.repeat(who, held)[order], keys[order], asks[order])

    def meet(table: pa.Table) -> pa.Table:
        who = np.repeat(_whole(table.column("nums"), _WHO), _joined(table.column("counts"), np.uint8))
        keys, asks = _whole(table.column("keys"), np.int64), _joined(table.column("extra"), np.uint8)
        nums, sizes = who["num"], who["size"]
        order = np.argsort(keys, kind="stable")
        runs = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        n = np.diff(runs, append=len(keys))
        order, n = order[np.repeat(np.maximum.reduceat(asks[order], runs), n) > 0], np.repeat(n, n)[np.repeat(np.maximum.reduceat(asks[order], runs), n) > 0]
        keys, nums, sizes, asks = keys[order], nums[order], sizes[order], asks[order] > 0
        order = np.lexsort((nums, -sizes, keys))
        keys, nums, sizes, asks = keys[order], nums[order], sizes[order], asks[order]
        hub = _bands(keys, sizes, threshold)
        idle = (hub == np.arange(len(hub))) | ~(asks | (asks[hub] & (sizes[hub] == sizes)))
        bucket = np.full(len(keys), table.column("bucket")[0].as_py(), np.int32)
        return pa.table({"bucket": bucket, "key": keys, "num": nums, "size": sizes, "asked": asks, "n": n.astype(np.int32), "o_num": pa.array(nums[hub], mask=idle), "o_size": pa.array(sizes[hub], mask=idle)})

    dealt = lists.select("num", "size", "asks", "keys").mapInArrow(out, _POSTINGS)
    return dealt.groupBy("bucket").applyInArrow(meet, "bucket int, key bigint, num bigint, size int, asked boolean, n int, o_num bigint, o_size int")


_PAIR = ["num", "size", "o_num", "o_size"]
_PAIRS = "num bigint, size int, o_num bigint, o_size int"


def _node() -> Column:
    """A document as one value; the lesser of two is ahead."""
    return F.struct((-F.col("copies")).alias("copies"), (-F.col("size")).alias("size"), F.col("id").isNull().alias("last"), "id", "h", "num")


def _linked(found: DataFrame) -> DataFrame:
    """The pairs with the document that is ahead as ``near``."""
    return found.select(F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near"), "containment").distinct()


def _moved(nodes: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``nodes`` with each value of ``column`` that ``roots`` (node, root) holds replaced by its root."""
    to = roots.select(F.col("node").alias("__from"), F.col("root").alias("__to"))
    return nodes.join(to, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def _ends_of(pointers: DataFrame) -> DataFrame:
    """(node, root) with every pointer followed to its end; each round doubles the distance."""
    while True:
        up = pointers.select(F.col("node").alias("u"), F.col("root").alias("higher"))
        stepped = materialise(pointers.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("u").isNotNull().alias("moved")), "round")
        release(pointers)
        if stepped.where("moved").isEmpty():
            return stepped.drop("moved")
        pointers = stepped


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (node, near; near is ahead) but the foremost of each component.

    In each round every node takes the foremost it is linked to, pointers are
    doubled until they end at roots, and links between different roots go on.
    """
    known = None
    while True:
        roots = _ends_of(materialise(links.groupBy("node").agg(F.min("near").alias("root")), "round"))
        known = roots if known is None else materialise(_moved(known, "root", roots).unionByName(roots), "components")
        ends = _moved(_moved(links, "node", roots), "near", roots).where(F.col("node") != F.col("near"))
        links = materialise(ends.select(F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near")).distinct(), "links")
        if links.isEmpty():
            return known


def _paired(met: DataFrame) -> DataFrame:
    """Each pair once, the larger document as the other."""
    turned = (F.col("size") > F.col("o_size")) | ((F.col("size") == F.col("o_size")) & (F.col("num") > F.col("o_num")))
    return met.select(*[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(_PAIR, _PAIR[2:] + _PAIR[:2])]).distinct()


def _beside(table: DataFrame) -> DataFrame:
    """``table`` for a join that moves only its rows, unless they are many."""
    return F.broadcast(table) if table.count() <= BESIDE else table


def _ranges(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, place) for all places of the ranges, some EXPANDED at once."""
    held = np.maximum(end - start, 0)
    upto = np.cumsum(held)
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EXPANDED, "right")))
        h = held[at:to]
        yield np.repeat(np.arange(at, to), h), np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(start[at:to], h)
        at = to


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}


def _once(found: list[np.ndarray], nums: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """The pairs of places in ``found`` as pairs of texts, each once, the larger as the other, of equal ones that with the larger number."""
    x, y = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    turned = (sizes[x] > sizes[y]) | ((sizes[x] == sizes[y]) & (nums[x] > nums[y]))
    x, y = np.where(turned, y, x), np.where(turned, x, y)
    order = np.lexsort((nums[y], nums[x]))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = (nums[x[1:]] != nums[x[:-1]]) | (nums[y[1:]] != nums[y[:-1]])
    x, y = x[first], y[first]
    return pa.table({"num": nums[x], "size": sizes[x], "o_num": nums[y], "o_size": sizes[y]})


def _across(meeting: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Each document with every comparable one that isn't smaller, holds a key it asks with and has another root."""
    gone = _beside(roots.select(F.col("node")["num"].alias("num"), F.col("root")["num"].alias("root")))
    named = meeting.join(gone, "num", "left").select("bucket", "key", "num", "size", "asked", F.coalesce("root", "num").alias("root"))

    def pair(table: pa.Table) -> pa.Table:
        t = _columns(table)
        order = np.lexsort((t["root"], t["key"]))
        keys, nums, sizes, asked, root = (t[c][order] for c in ("key", "num", "size", "asked", "root"))
        new = np.diff(keys, prepend=~keys[:1]) != 0
        runs, parts = np.flatnonzero(new), np.flatnonzero(new | (np.diff(root, prepend=root[:1]) != 0))
        ends, part_ends = np.append(runs[1:], len(keys)), np.append(parts[1:], len(keys))
        ask = np.flatnonzero(asked)
        run, part = np.searchsorted(runs, ask, "right") - 1, np.searchsorted(parts, ask, "right") - 1
        found = []
        # a bucket's documents of one root are never paired
        for start, end in ((runs[run], parts[part]), (part_ends[part], ends[run])):
            for which, y in _ranges(start, end):
                x = ask[which]
                fit = (sizes[x] <= sizes[y]) & (sizes[x] >= threshold * sizes[y] - 1e-9)
                if fit.any():
                    found.append(_distinct(np.stack([x[fit], y[fit]]), nums))
        return _once(found, nums, sizes)

    return named.groupBy("bucket").applyInArrow(pair, _PAIRS).distinct()


def _distinct(pairs: np.ndarray, nums: np.ndarray) -> np.ndarray:
    """Of pairs of places, one for each pair of texts."""
    order = np.lexsort((nums[pairs[1]], nums[pairs[0]]))
    pairs = pairs[:, order]
    first = np.ones(pairs.shape[1], bool)
    first[1:] = (nums[pairs[:, 1:]] != nums[pairs[:, :-1]]).any(axis=0)
    return pairs[:, first]


def _untried(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of ``a`` that are not in ``b``."""
    return a.join(b.select("num", "o_num"), ["num", "o_num"], "left_anti").select(*_PAIR)


def _standing(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(num, root, rank, extent) of the documents that aren't alone: their foremost, its place in the order (higher is ahead; ids don't count), the size of the largest of the group."""
    alone = nodes.where("copies > 1").select(_node().alias("node"), _node().alias("root"))
    every = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    every = every.unionByName(alone.join(every.select("node"), "node", "left_anti"))
    extent = every.groupBy("root").agg(F.max(-F.col("node")["size"]).cast("int").alias("extent"))
    rank = F.shiftleft((-F.col("root")["copies"]).cast("bigint"), 32) - F.col("root")["size"]
    return every.join(extent, "root").select(F.col("node")["num"].alias("num"), F.col("root")["num"].alias("root"), rank.alias("rank"), "extent")


def _far_larger(lo: int, hi: int, threshold: float, quote: int) -> Callable[[pa.Table], pa.Table]:
    """Of the postings of a bucket the pairs of a document that asks and a far larger one from ``lo`` up to ``hi`` in the order of the key's holders."""

    def pair(table: pa.Table) -> pa.Table:
        t = _columns(table)
        order = np.lexsort((t["num"], t["root"], -t["rank"], t["key"]))
        keys, nums, sizes, asked, root, rank, extent, b_rank, b_root = (t[c][order] for c in ("key", "num", "size", "asked", "root", "rank", "extent", "b_rank", "b_root"))
        runs = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        ends = np.append(runs[1:], len(keys))
        ask = np.flatnonzero(asked & (sizes >= quote))
        run = np.searchsorted(runs, ask, "right") - 1
        found = []
        for which, y in _ranges(runs[run] + lo, np.minimum(runs[run] + hi, ends[run])):
            x = ask[which]
            fit = (sizes[x] < threshold * sizes[y] - 1e-9) & (root[x] != root[y]) & (extent[x] < extent[y]) & (rank[y] >= b_rank[x]) & ~((b_rank[x] == rank[y]) & (b_root[x] == root[y]))
            if fit.any():
                found.append(_distinct(np.stack([x[fit], y[fit]]), nums))
        return _once(found, nums, sizes)

    return pair


def _quoted(meeting: DataFrame, lists: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float, quote: int) -> list[DataFrame]:
    """(node, near, containment): for each group with members in far larger documents of others, those of the foremost group among them.

    The holders of a key are tried in the order of their groups, a few at first
    and then eight times as many each round. What follows the foremost group
    that was found for a group isn't tried, so that a group needn't be compared
    with all that hold it; all else is.
    """
    standing = materialise(_standing(nodes, roots), "standing")
    placed = meeting.select("bucket", "key", "num", "size", "asked", "n").join(_beside(standing), "num", "left")
    placed = placed.withColumns({"root": F.coalesce("root", "num"), "rank": F.coalesce("rank", F.lit(1 << 32) + F.col("size")), "extent": F.coalesce("extent", "size")})
    most = meeting.agg(F.max("n")).first()[0] or 0
    out, best, lo, hi = [], None, 0, FIRST
    while lo < most:
        now = placed.where(F.col("n") > lo)
        if best is None:
            now = now.withColumns({"b_rank": F.lit(-1).cast("bigint"), "b_root": F.lit(0).cast("bigint")})
        else:
            now = now.join(_beside(best), F.col("root") == F.col("b_of"), "left").drop("b_of").fillna({"b_rank": -1, "b_root": 0})
        pairs = materialise(now.groupBy("bucket").applyInArrow(_far_larger(lo, hi, threshold, quote), _PAIRS).distinct(), "quoting")
        lo, hi = hi, hi * 8
        if pairs.isEmpty():
            release(pairs)
            continue
        inside = materialise(_contained(pairs, lists, nodes, threshold), "contained")
        release(pairs)
        if not inside.isEmpty():
            out.append(inside)
            ends = inside.select(F.col("node")["num"].alias("x_num"), F.col("near")["num"].alias("num"), (-F.col("near")["size"]).alias("size"))
            own = standing.select(F.col("num").alias("x_num"), F.col("root").alias("x_root"))
            told = ends.join(own, "x_num", "left").join(standing, "num", "left")
            rank = F.coalesce("rank", F.lit(1 << 32) + F.col("size"))
            more = told.select(F.coalesce("x_root", "x_num").alias("b_of"), rank.alias("b_rank"), F.coalesce("root", "num").alias("b_root"))
            more = more if best is None else more.unionByName(best)
            best = materialise(more.groupBy("b_of").agg(F.max(F.struct("b_rank", "b_root")).alias("b")).select("b_of", "b.b_rank", "b.b_root"), "best")
    return out


def _within(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """The pairs that reach the threshold, with their containment; ``pairs`` is a table that was written.

    Many documents can meet one: the second ones of the pairs are dealt to
    blocks of about BLOCK shingles, and each block gets every first one that it
    needs once.
    """
    size = pairs.select("o_num", "o_size").distinct().agg(F.sum("o_size")).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK))
    block = F.pmod(F.xxhash64("o_num"), F.lit(blocks)).alias("block")
    placed = pairs.select(block, *_PAIR)
    wanted = materialise(placed.select("block", F.col("o_num").alias("w_num")).unionByName(placed.select("block", F.col("num").alias("w_num"))).distinct(), "wanted")
    held = lists.select("num", "keys").join(_beside(wanted), F.col("num") == F.col("w_num")).select(F.col("block").alias("h_block"), "num", "keys")

    def meet(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        keys = {n: np.sort(x) for n, x in zip(docs["num"].tolist(), docs["keys"])}
        both = np.zeros(len(pairs), np.int64)
        for i, (n, o) in enumerate(zip(pairs["num"].tolist(), pairs["o_num"].tolist())):
            x, y = keys[n], keys[o]
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both[i] = np.count_nonzero(y[at] == x)
        pairs = pairs.assign(containment=both / np.minimum(pairs["size"], pairs["o_size"]).clip(lower=1))
        return pairs.loc[pairs["containment"] >= threshold - 1e-9, [*_PAIR, "containment"]]

    near = materialise(held.groupBy("h_block").cogroup(placed.groupBy("block")).applyInPandas(meet, f"{_PAIRS}, containment double"), "within")
    release(wanted)
    return near


def _contained(pairs: DataFrame, lists: DataFrame, nodes: DataFrame, threshold: float, rough: bool = True) -> DataFrame:
    """(node, near, containment) of the pairs that reach the threshold; ``pairs`` is a table that was written.

    ``rough``: most pairs will fail. Remainders of the shingles, a quarter as
    large, have at least as many in common as the shingles have, so pairs that
    fail by them do; only the others are compared by the shingles.
    """
    if rough:
        small = lists.select("num", F.transform("keys", lambda k: (k % REMAINDERS).cast("smallint")).alias("keys"))
        pairs = _within(pairs, small, threshold).select(*_PAIR)
    near = _within(pairs, lists, threshold)
    named = nodes.select(F.col("num").alias("n_num"), _node().alias("node"))
    one = near.join(named, F.col("num") == F.col("n_num")).select("o_num", "containment", "node")
    return one.join(named.withColumnRenamed("node", "near"), F.col("o_num") == F.col("n_num")).select("node", "near", "containment")


def _containers(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): foremost documents whose group goes in favour of a far larger document's group, and the foremost of the last of those.

    The larger group is the one whose largest document is larger, so no chain of
    groups comes back to where it began.
    """
    extent = roots.groupBy(F.col("root").alias("x_root")).agg(F.max(-F.col("node")["size"]).alias("extent"))
    ends = _moved(_moved(found.select("node", "near"), "node", roots), "near", roots)
    for c in ("node", "near"):
        ends = ends.join(extent, F.col(c) == F.col("x_root"), "left").withColumn(f"{c}_n", F.greatest(-F.col(c)["size"], F.coalesce("extent", F.lit(0)))).drop("x_root", "extent")
    up = materialise(ends.where(F.col("node_n") < F.col("near_n")).groupBy("node").agg(F.min("near").alias("root")), "containers")
    return _ends_of(up)


def _contents(docs: DataFrame) -> DataFrame:
    """(id, h, num) per row of (id, h, text) that has words."""
    kind = docs.schema["id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words = (words_of(t.as_py()) for t in batch.column("text"))
            nums = pa.array([content_of(w) if w else None for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), nums], ["id", "h", "num"])

    return docs.mapInArrow(batches, f"id {kind}, h bigint, num bigint").where(F.col("num").isNotNull())


def parents(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, quote: int = QUOTE) -> DataFrame:
    """``docs``: (id, h, text). Gives (id, h, o_id, o_h, containment): each document that doesn't stay, and the one it points to.

    Exact copies point to the first of them; all others point to a document
    that stays. Among the holders of a shingle every document is first compared
    with the largest one of comparable size only, which settles groups of many
    copies in a number of pairs that grows with the group; then with all of
    comparable size that are in other groups so far.
    """
    alike = W.partitionBy("num").orderBy(F.col("id").asc_nulls_last(), "h")
    numbered = _contents(docs).select("*", F.count(F.lit(1)).over(W.partitionBy("num")).alias("copies"), F.row_number().over(alike).alias("rn"), F.first("id").over(alike).alias("o_id"), F.first("h").over(alike).alias("o_h"))
    feats = materialise(numbered, "contents")
    same = feats.where("rn > 1").where(~(F.col("id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h")))).select("id", "h", "o_id", "o_h", F.lit(1.0).alias("containment")).distinct()

    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(chars / BYTES_A_SHINGLE / BUCKET))
    lists = _shared_lists(docs, buckets, threshold, width)
    nodes = materialise(feats.where("rn = 1").select("num", "id", "h", "copies").join(lists.select("num", "size"), "num"), "nodes")

    meeting = materialise(_met(lists, buckets, threshold), "buckets")
    star = materialise(_paired(meeting.where(F.col("o_num").isNotNull())), "star")
    found = materialise(_linked(_contained(star, lists, nodes, threshold, rough=False)), "foremost")
    roots = components(found)
    across = materialise(_untried(_across(meeting, roots, threshold), star), "across")
    more = materialise(_linked(_contained(across, lists, nodes, threshold)), "more")
    release(star, across)
    if not more.isEmpty():
        found = found.unionByName(more)
        roots = components(roots.select("node", F.col("root").alias("near")).unionByName(more.select("node", "near")))

    quoted = _quoted(meeting, lists, nodes, roots, threshold, quote)
    release(meeting, lists)
    if quoted:
        inside = functools.reduce(DataFrame.unionByName, quoted)
        found = found.unionByName(inside)
        higher = _containers(inside, roots)
        roots = materialise(_moved(roots, "root", higher).unionByName(higher), "contained-roots")

    both = found.select(F.col("node").alias("a"), F.col("near").alias("b"), "containment").unionByName(found.select(F.col("near").alias("a"), F.col("node").alias("b"), "containment"))
    best = both.groupBy("a").agg(F.min(F.struct("b", "containment"))["containment"].alias("containment"))
    near = roots.join(best, F.col("node") == F.col("a")).select(F.col("node")["id"].alias("id"), F.col("node")["h"].alias("h"), F.col("root")["id"].alias("o_id"), F.col("root")["h"].alias("o_h"), "containment")
    out = materialise(same.unionByName(near), "parents")
    release(feats, nodes)
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, quote: int = QUOTE) -> DataFrame:
    """One row per document that has a kept near duplicate: ``doc_id``, ``kept_id`` and ``containment``.

    ``kept_id`` is the one document of the group that stays; ``containment`` is
    that of the smaller in the larger of the document and the foremost one it
    was found near to, which need not be ``kept_id``. Texts that differ
    only in case, spacing and punctuation are equal. Null texts and texts
    without words are nobody's duplicates. Texts of fewer than ``width`` words
    match only equal ones. Rows that agree in id and text are one document; rows
    of one id with different texts are different documents; a null id is the
    last of ids; ties in the order go to the smaller id, then to the smaller
    hash of the text. Texts are compared whole. Extra columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    tree = parents(_keyed(docs, doc_id, text), threshold, width, quote)
    # exact copies point to the first of them, which may have gone itself; all else points to what stays
    up = tree.select(F.col("id").alias("u_id"), F.col("h").alias("u_h"), F.col("o_id").alias("r_id"), F.col("o_h").alias("r_h"))
    joined = tree.join(up, F.col("o_id").eqNullSafe(F.col("u_id")) & (F.col("o_h") == F.col("u_h")), "left")
    kept = F.when(F.col("u_h").isNotNull(), F.col("r_id")).otherwise(F.col("o_id"))
    return joined.select(F.col("id").alias(doc_id), kept.alias("kept_id"), F.round("containment", 6).alias("containment"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, quote: int = QUOTE) -> DataFrame:
    """The rows of ``docs`` without those that :func:`near_duplicates` reports; of rows that agree in id and text one stays.

    All columns are kept as they are, whatever their names. Null texts and
    texts without words stay, each id once; a null id counts as an id. Ties,
    very long texts and empty tables are treated as there.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    gone = parents(_keyed(docs, doc_id, text), threshold, width, quote).select(F.col("id").alias("g_id"), F.col("h").alias("g_h"))
    left = rows.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left_anti")
    # repeated rows are few: their surplus is told from the ids alone, and the texts of the others don't move for it
    twice = rows.groupBy("id", "h").count().where("count > 1").select(F.col("id").alias("t_id"), F.col("h").alias("t_h"))
    again = materialise(twice, "repeated")
    same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h"))
    once = left.join(again.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["id", "h"])
    return left.join(again.hint("shuffle_hash"), same, "left_anti").unionByName(once).select("row.*")
