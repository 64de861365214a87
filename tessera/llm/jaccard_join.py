"""Operator 10, n-gram Jaccard self-join by a size-aware heavy-light scheme.

A document's set holds its distinct shingles of width words (WIDTH; STAGE_WIDTH in the pipeline's stage),
A-Z lower-cased, as 64-bit hashes. Documents with equal sets form a node; copies never meet as pairs.
Two nodes link when the Jaccard similarity of their sets is at least percent in a hundred (PERCENT;
STAGE_PERCENT in the stage).

Light sets (up to a boundary) enumerate fixed-size subsets: a set of n may lack at most
e = n * (100 - percent) // 100 shingles of what it shares with a partner, so both emit that shared
subset among their subsets of n, ..., n - e shingles. Heavy sets are scanned in inverted lists of
shingles: a set is listed under its first e + 1 shingles in one order of all shingles, in which two
sets that link have at least one such shingle in common. The order puts the shingles that most documents hold
last, counted over all documents, so that passages which many documents share make long lists only for documents
that hold little else; the order changes what is scanned and never what links. Lists are kept apart
by class of size, and a set near the top of its class is listed in the next one, too. Light sets that a
heavy one may link with are also listed. The boundary minimises what both ways emit and scan,
counted over the sizes of all nodes.

Lists give candidates: each node of a list is compared with the list's pivot (its smallest node; a task
first does so with what it has of the list, so a list that many documents share is a few rows
per task). In a list whose nodes these links do not join into one component, each node outside the
pivot's component is compared with all of the list, in pairs of groups of at most GROUP nodes. Before sets are
compared, pairs pass an exact bound from bitmaps of about two bits a shingle: where the bits of two
sets' parities differ in h places, at least h shingles are in one set only. The pairs that pass in open lists
make clusters of nodes, which are compared in full, in pairs of groups of GROUP sets; a comparison
returns a spanning forest. Each pair that shares a list is therefore either compared exactly, excluded by the
bound, or already connected: no link is missed in what documents can reach, and no number of pairs grows
with the square of a group of copies.

Defined results: null, empty and blank texts have no shingles and are their own component; with
fewer than width words the sequence itself is the one shingle; repeated rows fall together with their
documents; rows with a null doc_id keep their component's smallest doc_id; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, lean, mix, placed, read, workers_import
from tessera.llm.graph import SALTS, components, forest
from tessera.llm.words import KEYS as _K
from tessera.llm.words import buffer_of, word_hashes

WIDTH = 3
PERCENT = 90
#: Of the pipeline's stage.
STAGE_WIDTH = 5
STAGE_PERCENT = 80
GROUP = 500
#: Rows of small lists that are compared in one group.
LOT = 5_000
#: A shingle is frequent from so many documents on; at most so many shingles are.
FREQUENT, MOST_FREQUENT = 3, 1 << 20
#: A light set is never larger; subsets of larger ones would be too many.
MOST_LIGHT = 40
#: How much more scanning a list's entry costs than emitting it.
SCAN = 4
#: Entries of lists that a task sorts at a time, and bytes of text that it hashes at a time.
HELD = 500_000
AT_ONCE = 1 << 20
#: Bits of the filter that keeps sets of nodes without candidates at home; its size is fixed.
FILTER_BITS = 1 << 25
_PLACES = [np.uint64(k) for k in range(101, 801, 100)]
_MASK = 2**64 - 1
_NONE = np.empty(0, np.uint64)


def shingles(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text of a string or binary column; nulls have none."""
    if not len(texts):
        return []
    h, first = word_hashes(*buffer_of(texts))
    n = len(h)
    whole = np.zeros(max(n - width + 1, 0), np.uint64)
    for i in range(width if len(whole) else 0):
        whole += mix(h[i : n - width + 1 + i] + _PLACES[i % 7]) * _K[i % 7]
    whole = mix(whole + np.uint64(width))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            s = np.zeros(1, np.uint64)
            for i in range(b - a):
                s += mix(h[a + i : a + i + 1] + _PLACES[i % 7]) * _K[i % 7]
            out.append(mix(s + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray, seed: int) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - 2**63


@functools.lru_cache(8)
def class_bounds(percent: int, upto: int = 1 << 33) -> list[int]:
    """Smallest sizes of the classes; a set links with sets of its class and of the neighbours only."""
    out = [1]
    while out[-1] < upto:
        out.append(-(-out[-1] * 10_000 // percent**2))
    return out


def classes(n: int, percent: int = PERCENT) -> list[int]:
    """Classes in which a set of n shingles is listed."""
    bounds = class_bounds(percent)
    k = bisect_right(bounds, n) - 1
    return [k, k + 1] if n * 100 >= percent * bounds[k + 1] else [k]


def missing(n: int, percent: int = PERCENT) -> int:
    """Most shingles of a set of n that a linked partner may lack."""
    return n * (100 - percent) // 100


def subsets(n: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, k) for k in range(missing(n, percent) + 1))


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest light size. sizes: number of nodes by size, complete up to MOST_LIGHT + 1 and above."""
    heavy = lambda n: (1 + SCAN) * (missing(n, percent) + 1) * len(classes(n, percent))
    # a light set that a heavy one may link with pays for both
    cost = lambda x: sum(c * ((subsets(n, percent) if n <= x else 0) + (heavy(n) if n * 100 >= percent * (x + 1) else 0)) for n, c in sizes.items())
    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def ranks(frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and the rank of each, 1 for the last of ``frequent``."""
    known = np.argsort(frequent)
    return frequent[known], (len(frequent) - known).astype(np.int32)


def signatures(sets: list[np.ndarray], light: int, percent: int = PERCENT, frequent: np.ndarray | tuple[np.ndarray, np.ndarray] = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """Names of the subsets and lists of sets, and the place of the set that each belongs to. frequent: shingles from the most frequent on, that come last in the order, or their ranks()."""
    known, ranked = frequent if isinstance(frequent, tuple) else ranks(frequent)
    names, owners = [], []
    for k, s in enumerate(sets):
        n = len(s)
        if 0 < n <= light:
            mixed = mix(s + _K[3]).tolist()
            level = [(0, sum(mixed) & _MASK)]
            sums = [level[0][1]]
            for _ in range(missing(n, percent)):
                level = [(j + 1, (v - mixed[j]) & _MASK) for i, v in level for j in range(i, n)]
                sums += [v for _, v in level]
            names.append(mix(np.array(sums, np.uint64) + _K[4]))
            owners.append(np.full(len(sums), k))
    listed = [k for k, s in enumerate(sets) if len(s) and len(s) * 100 >= percent * (light + 1)]
    if listed:
        size = np.array([len(sets[k]) for k in listed])
        s = np.concatenate([sets[k] for k in listed])
        if len(known):
            place = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[place] == s, ranked[place], 0)  # 0: not frequent
        first = np.cumsum(size) - size
        for k, lo, n in zip(listed, first.tolist(), size.tolist(), strict=True):
            want, x = missing(n, percent) + 1, s[lo : lo + n]
            if len(known) and rank[lo : lo + n].any():
                of = rank[lo : lo + n]
                rare = x[of == 0][:want]
                x = rare if len(rare) == want else x[np.lexsort((x, of))]
            for c in classes(n, percent):
                names.append(mix(mix(x[:want] + _K[6]) + np.uint64(c)))
                owners.append(np.full(want, k))
    return np.concatenate(names or [_NONE]), np.concatenate(owners or [np.empty(0, np.int64)])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by hash, in two to four bits a shingle, packed."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s ^ _K[5]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (the last axis) at a smaller size."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def may_link(n: np.ndarray | int, m: np.ndarray | int, apart: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m shingles can link if at least ``apart`` shingles are in one of them only."""
    both = (n + m - apart) // 2
    return 100 * both >= percent * (n + m - both)


def candidates(one: tuple[list[np.ndarray], np.ndarray, np.ndarray], other: tuple[list[np.ndarray], np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs from two lots (bitmaps, sizes, components) of different components that sizes and bitmaps allow to link."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    places = {}
    for k, words in enumerate(other[0]):
        places.setdefault(len(words), []).append(k)
    stacks = {w: (np.array(at), np.stack([other[0][k] for k in at])) for w, at in places.items()}
    for i, words in enumerate(one[0]):
        for w, (at, stack) in stacks.items():
            near = (other[2][at] != one[2][i]) & (np.minimum(other[1][at], one[1][i]) * 100 >= percent * np.maximum(other[1][at], one[1][i]))
            if near.any():
                at, least = at[near], min(w, len(words))
                apart = np.bitwise_count(folded(stack[near], least) ^ folded(words, least)).sum(1, dtype=np.int64)
                at = at[may_link(other[1][at], one[1][i], apart, percent)]
                found.append((np.full(len(at), i), at))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_matrix(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which pairs of sets link, by products of membership matrices over slices of their shingles."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    width = 4096
    for lo in range(0, int(column[-1]) + 1, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        both += m @ m.T
    return 100 * both >= percent * (size[:, None] + size[None] - both)


def _sets(spark: SparkSession, docs: DataFrame, work, schema: str, width: int = WIDTH) -> DataFrame:
    """work((doc_ids, places), sets) over the documents' sets, at most 200 and about AT_ONCE bytes of text at a time; it yields record batches."""
    workers_import(spark)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        upto = np.concatenate(([0], np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, min(lo + 200, int(np.searchsorted(upto, upto[lo] + AT_ONCE, side="right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work((b.columns[:1] + b.columns[2:], shingles(b.column(1), width)) for whole in batches for b in parts(whole))

    return docs.mapInArrow(lean(run), schema)


def nodes(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, int]:
    """doc_id, place, n_shingles, node and bits (its bitmap) of each document (a written table), and the seed under which nodes with different sets have different names."""
    seed = 0
    while True:

        def name(parts, seed=seed):
            for ids, sets in parts:
                columns = [*ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s, seed) if len(s) else None for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n_shingles", "node", "content", "bits"])

        found = cut(_sets(spark, docs, name, "doc_id long, place string, n_shingles long, node long, content binary, bits binary", width))
        twice = found.where("node is not null").groupBy("node").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high")
        if twice.isEmpty():
            return found.drop("content"), seed
        seed += 1


def frequent_shingles(spark: SparkSession, docs: DataFrame, entries: int, width: int = WIDTH, held: int = HELD) -> np.ndarray:
    """Shingles that FREQUENT or more of all documents hold, from the most frequent on.

    A task counts up to ``held`` shingles at a time and sends them as packed arrays, one row for each of about
    entries / held ranges of shingles, where the counts are added up. Ranges share MOST_FREQUENT alike: one with
    more frequent shingles than that gives its most frequent ones.
    """
    ranges = max(2, -(-entries // held))
    wide = np.uint64(2**64 // ranges + 1)
    most = max(1, MOST_FREQUENT // ranges)

    def row(key: int, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([x.astype("<u8").tobytes()], pa.binary()), pa.array([n.astype("<u4").tobytes()], pa.binary())], ["range", "shingles", "counts"])

    def count(parts: Iterator[tuple[list, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        lots: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, n = np.unique(np.concatenate(lots), return_counts=True)
            border = np.searchsorted(x // wide, np.arange(ranges + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(border)).tolist():
                part = slice(border[k], border[k + 1])
                yield row(k, x[part], n[part])

        for _, sets in parts:
            lots += sets
            size += sum(map(len, sets))
            if size > held:
                yield from flush()
                lots, size = [], 0
        if size:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("shingles").to_pylist()), "<u8")
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
        order = np.argsort(x)
        x, n = x[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        x, n = x[first], np.add.reduceat(n, first)
        x, n = x[n >= FREQUENT], n[n >= FREQUENT]
        order = np.lexsort((x, -n))[:most]
        return pa.table({"shingles": pa.array([x[order].astype("<u8").tobytes()], pa.binary()), "counts": pa.array([n[order].astype("<i8").tobytes()], pa.binary())})

    lots = _sets(spark, docs, count, "range long, shingles binary, counts binary", width)
    found = lots.groupBy("range").applyInArrow(meet, "shingles binary, counts binary").toArrow()  # at most MOST_FREQUENT shingles
    x = np.frombuffer(b"".join(found.column("shingles").to_pylist()), "<u8").astype(np.uint64)
    n = np.frombuffer(b"".join(found.column("counts").to_pylist()), "<i8")
    return x[np.lexsort((x.view(np.int64), -n))]


def list_members(spark: SparkSession, docs: DataFrame, seed: int, light: int, entries: int, frequent: np.ndarray = _NONE, percent: int = PERCENT, width: int = WIDTH, held: int = HELD) -> DataFrame:
    """list, node, pivot: members of the lists that hold more than one node, each with a smaller or equal node of its list; written.

    A task sorts up to ``held`` entries at a time and sends one node of each list, the smallest, to meet those
    of other lots: entries travel as packed arrays, one row for each of about entries / held ranges of
    list names. A list that many documents share is thus one entry from each lot; what it holds inside a
    lot is dealt evenly over as many other groups.
    """
    ranges = max(2, -(-entries // held))
    sent = spark.sparkContext.broadcast(ranks(frequent))
    wide = np.uint64(2**64 // ranges + 1)

    def row(key: int, *arrays: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x.astype("<u8").tobytes()], pa.binary()) for x in arrays)], ["range", "lists", "nodes", "pivots"])

    def emit(parts: Iterator[tuple[list, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        lists: list[np.ndarray] = []
        names: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            at, node, pivot = _pivots(np.concatenate(lists), np.concatenate(names))
            head = pivot == node
            several = head.copy()  # heads of lists that hold more here
            several[:-1] &= ~head[1:]
            several[-1:] = False
            border = np.searchsorted(at // wide, np.arange(ranges + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(border)).tolist():
                part = slice(border[k], border[k + 1])
                a, n, p, h = at[part], node[part], pivot[part], head[part]
                yield row(k, a[h], n[h], several[part][h])
                if not h.all():
                    yield row(-1 - (k + int(at[0] & np.uint64(0xFFFFFF))) % ranges, a[~h], n[~h], p[~h])

        for _, sets in parts:
            found, owner = signatures(sets, light, percent, sent.value)
            lists.append(found)
            names.append(np.array([node_of(s, seed) for s in sets], np.int64).view(np.uint64)[owner])
            size += len(found)
            if size > held:
                yield from flush()
                lists, names, size = [], [], 0
        if size:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        lists, nodes, pivots = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u8") for c in ("lists", "nodes", "pivots"))
        if table.column("range")[0].as_py() >= 0:  # heads, with a mark where their lists hold more
            marked = np.unique(lists[pivots > 0])
            lists, nodes, pivots = _pivots(lists, nodes)
            kept = pivots != nodes
            kept[:-1] |= kept[1:] & (lists[:-1] == lists[1:])
            kept |= np.isin(lists, marked)
            lists, nodes, pivots = lists[kept], nodes[kept], pivots[kept]
        return pa.table({k: x.astype(np.uint64).view(np.int64) for k, x in (("list", lists), ("node", nodes), ("pivot", pivots))})

    lots = _sets(spark, docs, emit, "range long, lists binary, nodes binary, pivots binary", width)
    out = cut(lots.groupBy("range").applyInArrow(meet, "list long, node long, pivot long"))
    sent.destroy()
    return out


def _pivots(at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs by list and then node (as a signed number), each with the first node of its list."""
    order = np.lexsort((node.view(np.int64), at))
    at, node = at[order], node[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (node[1:] != node[:-1])
    at, node = at[new], node[new]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    return at, node, node[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] if len(at) else node


def candidate_sets(spark: SparkSession, docs: DataFrame, members: DataFrame, seed: int, width: int = WIDTH) -> DataFrame:
    """node, shingles (binary) of the nodes of members; written. A filter of fixed size keeps others from the shuffle."""
    slot = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast(node & {FILTER_BITS - 1} & 63 as int))")
    words = members.select("node").groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bits)

    def fetch(parts):
        seen: set[int] = set()
        for _, sets in parts:
            kept: dict[int, bytes] = {}
            for s in sets:
                if len(s):
                    node = node_of(s, seed)
                    slot = node & (FILTER_BITS - 1)
                    if int(sent.value[slot >> 6]) >> (slot & 63) & 1 and node not in seen:
                        kept[node] = s.tobytes()
            if len(seen) > 500_000:
                seen = set()
            seen.update(kept)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.binary())], ["node", "shingles"])

    found = _sets(spark, docs, fetch, "node long, shingles binary", width)
    known = members.select(F.col("node").alias("m")).distinct()
    out = cut(found.groupBy("node").agg(F.min("shingles").alias("shingles")).join(known, F.col("node") == F.col("m"), "left_semi"))
    sent.destroy()
    return out


def pivot_pairs(members: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, pivot: pairs that the sizes and bitmaps of nodes (node, n, bits) allow to link; written."""
    pairs = members.where("node <> pivot").select("node", "pivot").distinct()
    pairs = pairs.join(known, "node").join(known.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("bits").alias("others")), "pivot")
    pairs = pairs.where(F.greatest("n", "m") * percent <= F.least("n", "m") * 100)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            apart = np.zeros(b.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(b.column(3), b.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least = min(len(x), len(y))
                apart[k] = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["node", "pivot"]).filter(pa.array(may_link(n, m, apart, percent)))

    return cut(pairs.select("node", "pivot", "n", "bits", "m", "others").mapInArrow(lean(bound), "node long, pivot long"))


def compare_pivots(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the pairs that link; written."""
    pairs = pairs.join(sets.withColumnRenamed("shingles", "x"), "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("y")), "pivot")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, pivot, x, y = (b.column(k) for k in range(4))
            keep = [linked(np.frombuffer(i.as_buffer(), np.uint64), np.frombuffer(j.as_buffer(), np.uint64), percent) for i, j in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([node, pivot], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(pairs.select("node", "pivot", "x", "y").mapInArrow(lean(compare), "a long, b long"))


def open_pairs(members: DataFrame, joined: DataFrame, known: DataFrame, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """a, b: pairs of different components (joined: node, component) inside lists, as spanning forests of those that sizes and bitmaps (known: node, n, bits) allow to link; written."""
    rows = members.select("list", "node").distinct().join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = F.min(F.struct("node", "component"))
    of_list = rows.groupBy("list").agg(F.count(F.lit(1)).alias("size"), low["component"].alias("main"), F.min("component").alias("first"), F.max("component").alias("last"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mixed"), F.bit_xor("node").alias("xor"))
    # two nodes have been compared; of lists with the same nodes one is enough
    of_list = of_list.where("size > 2 and first <> last").groupBy("size", "mixed", "xor").agg(F.min("list").alias("at"), F.min_by("main", "list").alias("main"))
    rows = cut(rows.join(of_list.select("at", "size", "main"), F.col("list") == F.col("at")).select("list", "size", "node", "component", (F.col("component") != F.col("main")).alias("apart")))
    # small lists are compared by themselves, many in one group of rows
    small = F.col("size") <= group
    lots = 1 + rows.where(small).count() // LOT
    rows = rows.join(known, "node")
    alone = rows.where(small).select(F.pmod(F.xxhash64("list"), F.lit(lots)).alias("unit"), "list", "node", "component", "n", "bits", "apart", F.lit(True).alias("inner"))
    # of a large one each group of nodes outside the main component meets each group of all
    large = rows.where(~small)
    outside = large.groupBy(F.col("list").alias("at")).agg(F.ceil(F.count_if("apart") / group).alias("parts"))
    large = large.join(outside, F.col("list") == F.col("at")).withColumn("wholes", F.ceil(F.col("size") / group))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = [(-1 - F.shiftrightunsigned(F.xxhash64("list", "p", "q"), 1)).alias("unit"), F.xxhash64("list", "p", "q").alias("list"), "node", "component", "n", "bits", "apart", "inner"]
    ones = large.where("apart").select("list", "node", "component", "n", "bits", "apart", F.lit(False).alias("inner"), part("parts").alias("p"), upto("wholes").alias("q"))
    others = large.select("list", "node", "component", "n", "bits", F.lit(False).alias("apart"), F.lit(True).alias("inner"), part("wholes").alias("q"), upto("parts").alias("p"))
    dealt = alone.unionByName(ones.unionByName(others).select(*columns))

    def meet(table: pa.Table) -> pa.Table:
        at, node, component, n = (table.column(c).to_numpy() for c in ("list", "node", "component", "n"))
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bits")]
        apart, inner = (table.column(c).to_numpy() for c in ("apart", "inner"))
        order = np.argsort(at, kind="stable")
        border = np.append(np.flatnonzero(np.diff(at[order], prepend=at[order[0]] - 1)), len(at))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            rows = order[lo:hi]
            lots = [rows[apart[rows]], rows[inner[rows]]]
            i, j = candidates(*(([words[k] for k in lot.tolist()], n[lot], component[lot]) for lot in lots), percent)
            if len(i):
                found.append((node[lots[0][i]], node[lots[1][j]]))
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (node[:0], node[:0])
        kept = forest(a, b)
        return pa.table({"a": a[kept], "b": b[kept]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return cut(dealt.groupBy("unit").applyInArrow(meet, "a long, b long"))


def compare_clusters(clusters: DataFrame, sets: DataFrame, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """a, b: links inside clusters (node, component), as spanning forests; written. sets: node, shingles."""
    size = clusters.groupBy(F.col("component").alias("of")).agg(F.ceil(F.count(F.lit(1)) / group).alias("groups"))
    rows = clusters.join(size, F.col("component") == F.col("of")).withColumn("g", F.pmod(F.xxhash64("node"), F.col("groups")))
    # each pair of groups once: a group goes to all pairs that it is part of
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    rows = rows.select("component", "node", F.least("g", "other").alias("p"), F.greatest("g", "other").alias("q")).join(sets, "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        node = frame["node"].to_numpy()
        found = link_matrix([np.frombuffer(x, np.uint64) for x in frame["shingles"]], percent)
        i, j = np.nonzero(np.triu(found, 1))
        kept = forest(i, j)
        return pd.DataFrame({"a": node[i[kept]], "b": node[j[kept]]})

    return cut(rows.groupBy("component", "p", "q").applyInPandas(compare, "a long, b long"))


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, held: int = HELD, group: int = GROUP) -> DataFrame:
    """doc_id, place, n_shingles, root (the name of the component; null without shingles) and component_id for each row of docs (doc_id, text and, if wanted, place)."""
    place = F.col("place").cast("string") if "place" in docs.columns else F.lit(None).cast("string").alias("place")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place)
    named, seed = nodes(spark, docs, width)
    known = named.where("node is not null").select("node", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["node"])
    sized = known.groupBy(F.least("n", F.lit(MOST_LIGHT * 100 // percent + 2)).alias("n")).agg(F.count(F.lit(1)).alias("nodes"))
    light = boundary({r["n"]: r["nodes"] for r in sized.collect()}, percent)  # at most MOST_LIGHT * 100 / percent + 2 rows
    total, shingled = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    forget(spark)
    frequent = frequent_shingles(spark, docs, shingled, width, held)
    forget(spark)
    members = list_members(spark, docs, seed, light, total + shingled * (100 - percent) // 100, frequent, percent, width, held)
    forget(spark)
    pairs = pivot_pairs(members, known, percent)
    sets = candidate_sets(spark, docs, cut(pairs.select("node").union(pairs.select("pivot")).distinct()), seed, width)
    forget(spark)
    links = compare_pivots(pairs, sets, percent)
    del sets
    forget(spark)
    clusters = components(open_pairs(members, components(links), known, percent, group))
    forget(spark)
    more = compare_clusters(clusters, candidate_sets(spark, docs, clusters, seed, width), percent, group)
    joined = components(links.union(more)).withColumnRenamed("node", "linked")
    found = cut(named.join(joined, F.col("node") == F.col("linked"), "left").select("doc_id", "place", "n_shingles", F.coalesce("component", "node").alias("root")))
    smallest = found.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("smallest"))
    smallest = smallest.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # the rows of a large component are dealt over salts
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return found.withColumn("salt", salt).join(smallest, (F.col("root") == F.col("r")) & (F.col("salt") == F.col("s")), "left").select("doc_id", "place", "n_shingles", "root", F.coalesce("smallest", "doc_id").alias("component_id"))


def op10_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked rows the one with the smallest doc_id (null last) stays; rows without words all stay."""
    rows = placed(docs)
    found = jaccard_components(spark, rows.select("__doc.doc_id", "__doc.text", F.col("__place").alias("place")), STAGE_PERCENT, STAGE_WIDTH)
    found = cut(found.select("doc_id", "place", "root"))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"))
    kept = first.select(F.col("first.place").alias("kept")).union(found.where("root is null").select("place"))
    return rows.join(kept, F.col("__place") == F.col("kept"), "left_semi").select("__doc.*")


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - {WIDTH - 1}), lambda i: array_to_string(w[i:i+{WIDTH - 1}], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (n + m - c)),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l2.b FROM r JOIN l2 ON r.b = l2.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) x ON x.a = s.doc_id
"""
