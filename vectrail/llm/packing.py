"""Packing of documents into fixed-size training sequences by bin completion.

The search takes the largest unpacked document, enumerates the undominated sets
of others that fill its sequence, fullest first, and branches over them. A
branch ends when the space it has wasted exceeds what any better solution may
waste. The incumbent at the start is the best-fit-decreasing packing; whatever
better packing the search meets replaces it. The one limit is ``node_budget``,
the number of sets looked at in a group.

Groups are packed independently, then the emptiest sequence of each is packed
again together with those of the others, until one group is left.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

CAPACITY = 2048
GROUP_SIZE = 512
NODE_BUDGET = 2000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit over ``lengths`` in descending order; bins of indices."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (left - lengths[i], b))
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's L2: documents over ``capacity - t`` share with none that is ``t`` or longer."""
    if not lengths:
        return 0
    d = sorted(lengths, reverse=True)
    upto = [0]
    for x in d:
        upto.append(upto[-1] + x)
    desc = [-x for x in d]
    best = math.ceil(upto[-1] / capacity)
    for t in {x for x in d if x <= capacity // 2}:
        big = bisect_left(desc, -(capacity - t))  # longer than capacity - t
        half = bisect_left(desc, -(capacity // 2))  # longer than half
        small = bisect_left(desc, -t + 1)  # t or longer
        mid, low = upto[half] - upto[big], upto[small] - upto[half]
        best = max(best, half + max(0, math.ceil((low - ((half - big) * capacity - mid)) / capacity)))
    return best


def _sums(chosen: tuple[int, ...]) -> tuple[int, int]:
    """The sums of single elements, and of sets of two and more, as bits."""
    one, more = 0, 0
    for x in chosen:
        more |= (one | more) << x
        one |= 1 << x
    return one, more


def _undominated(chosen: tuple[int, ...], slack: int, left: list[int]) -> bool:
    """False if one document that is left can take the place of some chosen ones and fill at least as much.

    Any packing that uses ``chosen`` stays valid when the two are exchanged, so
    the set with the larger document in their place is at least as good.
    """
    one, more = _sums(chosen)
    for x in left:
        low = max(0, x - slack)
        width = x - low
        if (more >> low) & ((1 << width + 1) - 1) or (one >> low) & ((1 << width) - 1):
            return False
    return True


def _fillings(sizes: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of ``room`` from a multiset, fullest first; None for each one that is dominated. ``sizes``: descending, distinct.

    ``reach[i]`` has a bit for each sum that the sizes from the i-th on can
    make, so sets of a given sum are enumerated without a dead end.
    """
    sizes = [x for x in sizes if x <= room]
    reach = [1] * (len(sizes) + 1)
    limit = (1 << room + 1) - 1
    for i in range(len(sizes) - 1, -1, -1):
        x, most, sums, took = sizes[i], min(counts[sizes[i]], room // sizes[i]), reach[i + 1], 1
        while most:  # a count in powers of two
            took = min(took, most)
            sums |= (sums << took * x) & limit
            most -= took
            took *= 2
        reach[i] = sums

    def of(total: int) -> Iterator[tuple[int, ...]]:
        stack = [(0, total, ())]
        while stack:
            at, rest, chosen = stack.pop()
            if not rest:
                yield chosen
                continue
            while not sizes[at] <= rest:
                at += 1
            x = sizes[at]
            for k in range(min(counts[x], rest // x) + 1):  # the last pushed, with most of the larger, is next
                if (reach[at + 1] >> (rest - k * x)) & 1:
                    stack.append((at + 1, rest - k * x, chosen + (x,) * k))

    sums = reach[0]
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        slack = room - total
        for chosen in of(total):
            used: dict[int, int] = {}
            for x in chosen:
                used[x] = used.get(x, 0) + 1
            left = [x for x in sizes if counts[x] > used.get(x, 0)]
            yield chosen if (not left or left[-1] > slack) and _undominated(chosen, slack, left) else None


def complete(lengths: list[int], capacity: int, node_budget: int = NODE_BUDGET) -> list[list[int]]:
    """Bins of indices into ``lengths`` (each 1..capacity): the best packing found while looking at ``node_budget`` fillings."""
    incumbent = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(incumbent) <= bound:
        return incumbent
    total = sum(lengths)
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    best: list[tuple[int, ...]] | None = None
    most_bins = len(incumbent)
    path: list[tuple[int, ...]] = []
    waste, nodes = 0, 0

    def options() -> Iterator[tuple[int, ...] | None]:
        left = {x: n for x, n in counts.items() if n}
        largest = max(left)
        left[largest] -= 1
        sizes = sorted((x for x, n in left.items() if n), reverse=True)
        for f in _fillings(sizes, left, capacity - largest):
            yield None if f is None else (largest, *f)

    stack = [options()]
    while stack:
        filling = next(stack[-1], ()) if nodes < node_budget else ()
        if filling is None:
            nodes += 1
            continue
        if not filling:
            stack.pop()
            if path:
                done = path.pop()
                waste -= capacity - sum(done)
                for x in done:
                    counts[x] += 1
            continue
        nodes += 1
        lost = capacity - sum(filling)
        if waste + lost > (most_bins - 1) * capacity - total:
            stack[-1] = iter(())  # those that follow are emptier
            continue
        for x in filling:
            counts[x] -= 1
        path.append(filling)
        waste += lost
        if any(counts.values()):
            stack.append(options())
            continue
        if len(path) < most_bins:
            best, most_bins = list(path), len(path)
        done = path.pop()
        waste -= capacity - sum(done)
        for x in done:
            counts[x] += 1
        if most_bins <= bound:
            break
    if best is None:
        return incumbent
    places: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), reverse=True):
        places.setdefault(lengths[i], []).append(i)
    return [[places[x].pop() for x in filling] for filling in best]


def word_count(text: Column) -> Column:
    """Length of a document: its runs without space, tab or line break. 0 for null."""
    flat = F.coalesce(text, F.lit(""))
    for blank in "\n\r\t":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(flat, " "), ""))


_OUT = "piece bigint, from_word bigint, n_words bigint, bin_id bigint, tie bigint, loose boolean"


def _cut(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Documents (doc, n, tie, grp) in pieces of ``capacity`` words and a remainder."""
    n = pdf["n"].to_numpy(np.int64)
    pieces = n // capacity + (n % capacity > 0)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return pdf[["doc", "tie", "grp"]].iloc[row].assign(piece=piece, from_word=piece * capacity, n_words=np.minimum(capacity, n[row] - piece * capacity))


def _pack_group(pdf: pd.DataFrame, capacity: int, group_size: int, node_budget: int) -> pd.DataFrame:
    """Pieces (doc, tie, grp, piece, from_word, n_words) with their bins, and whether theirs is the group's emptiest."""
    # the order makes the result a function of the rows alone
    pdf = pdf.sort_values(["n_words", "doc", "tie", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    size = pdf["n_words"].to_numpy(np.int64)
    bins, used = np.arange(len(size)), int((size == capacity).sum())
    items = np.arange(used, len(size))
    parts = max(1, round(len(items) / group_size))  # a group made larger by rows of one id is dealt out
    for p in range(parts):
        at = items[p::parts]
        packed = complete(size[at].tolist(), capacity, node_budget)
        for b, members in enumerate(packed):
            bins[at[members]] = used + b
        used += len(packed)
    fill = np.bincount(bins, weights=size)
    loose = (bins == int(fill.argmin())) & (fill.min() < capacity)
    base = np.int64(pdf["grp"].iloc[0]) << np.int64(32)
    return pdf[["doc", "piece", "from_word", "n_words"]].assign(bin_id=base + bins, tie=pdf["tie"], loose=loose)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_size: int = GROUP_SIZE, node_budget: int = NODE_BUDGET) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``from_word``, ``n_words``, ``bin_id``; a bin holds at most ``capacity`` words.

    A document longer than ``capacity`` is cut into pieces that fill bins of
    their own and a remainder that is packed like any document. Documents are
    spread over groups of about ``group_size`` by a hash of their id, each
    packed alone, and the emptiest bin of each group is packed again with those
    of others; so the result doesn't depend on how rows are partitioned.
    Documents without words, null texts among them, need no space and give no
    row. Repeated rows are packed each; a null id is an id. Ties in length are
    broken by id and then text. Extra columns are not read, whatever their
    names; an empty table gives an empty result.
    """
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, {_OUT}"
    rows = docs.select(F.col(doc_id).alias("doc"), word_count(F.col(text)).alias("n"), F.xxhash64(F.col(text)).alias("tie")).where(F.col("n") > 0)
    groups = max(1, math.ceil(docs.count() / group_size))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc"), F.lit(groups)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(_cut(pdf, capacity), capacity, group_size, node_budget)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(pdf, capacity, group_size, node_budget)

    columns, done, base = ["doc", "piece", "from_word", "n_words", "bin_id"], [], 0
    while True:
        packed = materialise(dealt.groupBy("grp").applyInPandas(again if base else first, schema), "packed")
        if groups == 1:
            break
        done.append(packed.where("not loose").select(columns))
        base += groups
        loose = packed.where("loose")
        # at most a quarter as many, so that it ends where a bin holds more documents than a group
        groups = max(1, min(groups // 4, math.ceil(loose.count() / group_size)))
        dealt = loose.select("doc", "tie", "piece", "from_word", "n_words", (F.pmod(F.xxhash64("doc", "tie", "piece"), F.lit(groups)) + base).alias("grp"))
    return reduce(DataFrame.unionByName, done, packed.select(columns)).withColumnRenamed("doc", doc_id)
