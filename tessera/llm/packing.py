"""Operator 6, packing token pieces into sequences by best fit and swap-based local search.

Each document becomes its ids and an end id; only one longer than the capacity is cut, into full
pieces behind a first piece that holds the rest. Full pieces are sequences by themselves. The other
pieces are dealt evenly over blocks of about BLOCK pieces (by a hash of the row's number, so that
repeated rows and hot sources spread); in each block best fit decreasing makes the bins, and local
search then takes the emptiest bins and tries to empty them: a piece moves into a fuller bin, or is
exchanged with one or with two smaller pieces of a fuller bin. Each step raises the sum of squared
fills, so the search ends; it also ends when the bins are as few as their tokens allow. A block
wastes less than one sequence for each of its last bins, however many blocks there are.

Defined results: a null or empty text is its end id alone; repeated rows are packed each time; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, read, workers_import
from tessera.llm.tokens import PATH, RANKS, encode

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs together.
BLOCK = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Borders of the pieces of n ids: all but the first piece are full."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = PATH, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids array<int>) of each piece of each row of docs."""
    workers_import(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text, path, ranks), np.uint32(end_id)).astype("<u4")
                at = cut_points(len(ids), capacity)
                for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
                    for column, x in zip(out, (doc_id, k, i, j - i, zlib.crc32(ids[i:j]), ids[i:j].astype(np.int32) if with_ids else None), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()) + ((pa.list_(pa.int32()),) if with_ids else ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, PIECES + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indices) of best fit decreasing: each size goes where the least room stays."""
    free: list[int] = []  # sorted rooms that some bin has
    at: dict[int, list[int]] = {}  # bins by room
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(free, size)
        if k < len(free):
            room = free[k]
            b = at[room].pop()
            if not at[room]:
                del at[room], free[k]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            if left not in at:
                at[left] = []
                insort(free, left)
            at[left].append(b)
    return bins


def any_step(bins: list[list[int]], size: list[int], fill: list[int], order: list[int], capacity: int) -> tuple[int, int] | None:
    """A source and a target among the bins of order (emptiest first) that have a step, the fullest target; None if no two have one."""
    fills = np.array([fill[k] for k in order])
    room = capacity - fills
    at = np.repeat(np.arange(len(order)), [len(bins[k]) for k in order])
    single = np.array([size[j] for k in order for j in bins[k]])
    twos = [(x, size[i] + size[j]) for x, k in enumerate(order) for y, i in enumerate(bins[k]) for j in bins[k][y + 1 :]]
    pair_at, pair = np.array([x for x, _ in twos], np.int64), np.array([v for _, v in twos], np.int64)
    for x, a in enumerate(order):
        for s in sorted({size[i] for i in bins[a]}, reverse=True):
            fits = np.flatnonzero(room[x:] >= s) + x
            ones = at[(single < s) & (single >= s - room[at]) & (at >= x)]
            both = pair_at[(pair < s) & (pair >= s - room[pair_at]) & (pair_at >= x)]
            found = np.concatenate([fits, ones, both])
            found = found[(found != x) & (fills[found] >= fills[x])]
            if len(found):
                return a, order[int(found.max())]
    return None


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, width: int = 64) -> list[list[int]]:
    """bins with fewer or fuller bins: steps that raise the sum of squared fills, until no underfull bin has any.

    Sources of steps are the ``width`` emptiest bins, their targets fuller bins among the 4 * width emptiest, the
    fullest first. Where these have no step left, all pairs of underfull bins are looked at (any_step), and the
    search ends when not even these have one. Steps: move one piece; exchange it with one smaller piece; exchange it with two
    pieces that are smaller together.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = {k for k, f in enumerate(fill) if f < capacity}
    count = len(bins)

    def step(a: int, targets: list[int]) -> bool:
        for i in sorted(bins[a], key=lambda i: -size[i]):
            for b in targets:
                if b == a or fill[b] < fill[a]:
                    continue
                room = capacity - fill[b]
                give: list[int] | None = None
                if size[i] <= room:
                    give = []
                else:  # what comes back must leave room and be smaller than the piece
                    low, high = size[i] - room, size[i] - 1
                    ones = [j for j in bins[b] if low <= size[j] <= high]
                    if ones:
                        give = [min(ones, key=lambda j: size[j])]
                    else:
                        small = [j for j in bins[b] if size[j] < high]
                        give = next(([j, k] for x, j in enumerate(small) for k in small[x + 1 :] if low <= size[j] + size[k] <= high), None)
                if give is None:
                    continue
                back = sum(size[j] for j in give)
                bins[a] = [j for j in bins[a] if j != i] + give
                bins[b] = [j for j in bins[b] if j not in give] + [i]
                fill[a] += back - size[i]
                fill[b] += size[i] - back
                return True
        return False

    while count > least:
        order = sorted(live, key=lambda k: (fill[k], k))
        targets = order[: 4 * width][::-1]
        moved = False
        for a in order[:width]:
            while bins[a] and step(a, targets):
                moved = True
            if not bins[a]:
                live.discard(a)
                count -= 1
                break
        live = {k for k in live if fill[k] < capacity}
        if not moved:
            pair = any_step(bins, size, fill, sorted(live, key=lambda k: (fill[k], k)), capacity)
            if pair is None or not step(pair[0], [pair[1]]):
                break
            if not bins[pair[0]]:
                live.discard(pair[0])
                count -= 1
    return [b for b in bins if b]


def place(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """frame (one block) with sequence_id and offset."""
    sizes = frame["length"].to_numpy()
    bins = local_search(best_fit(sizes, capacity), sizes, capacity)
    which, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, b in enumerate(bins):
        which[b] = k
        offset[b] = np.concatenate(([0], np.cumsum(sizes[b])[:-1]))
    return frame.assign(sequence_id=frame["block"].to_numpy() * 2**32 + which, offset=offset)


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """piece_rows (a written table with length) with sequence_id and offset; its other columns stay."""
    workers_import(piece_rows.sparkSession)
    numbered = piece_rows.withColumn("__row", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("__row") - 1, "offset": F.lit(0).cast("long")}).drop("__row")
    rest = numbered.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(blocks))).drop("__row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long"
    placed = rest.groupBy("block").applyInPandas(lambda frame: place(frame, capacity), schema)
    return full.unionByName(placed.drop("block"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(read(spark, sf_dir, "documents"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: one row per piece with its sequence and place."""
    return pack(cut(pieces(docs)))
