"""Operator 3, mixing sources to target weights by cube-method balanced sampling.

A source's weight goes by its rank in code-point order (null last): WEIGHTS, repeating. Targets share
all words by weight; none exceeds MOST times its source's words, and the excess is reshared by weight
until none is above. A document of a source is expected target / words of the source times: the whole
part is taken as copies, and the fraction is its inclusion probability, which the cube method turns
into 0 or 1. A flight moves the probabilities of three documents at a time along the null space of
two constraints (the expected number of documents and of words stays exactly as it is) until one of
them is 0 or 1. It runs in blocks of about BLOCK documents of a source, each of which leaves at most two
fractions open; these go through further flights in blocks until a source's open fractions fit one
block. The last flight stops at LANDING open fractions: the landing takes those whose words come nearest
to the expected ones, by trying all subsets.

All orders and choices follow doc_id, size and fixed seeds, so reruns agree.

Defined results: null and empty texts have size 0 and take 0 words; sources without words have target
0; null is a source of its own, the last; repeated rows are documents of their own, each taken at
most MOST times; an empty table gives no rows; other columns stay untouched (equal names are replaced).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, n_words, placed, read, workers_import

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents in one flight.
BLOCK = 5_000
LANDING = 14
#: Sources of which the targets are sent to every executor; beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, size) to one row per source: source, source_size, target, expected (times a document is taken).

    The level that shares the words is found by repeated sums over the sources: each round fixes
    the sources above their limit, and the set of those only grows.
    """
    by_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    ranked = by_source.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))  # one row per source
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.col("__rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = cut(ranked.withColumn("__weight", weight))
    most_of = F.col("source_size") * F.lit(float(most))
    level, fixed = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("__weight") * F.lit(level) >= most_of
        s = ranked.agg(
            F.count_if(above).alias("n"), F.sum("source_size").alias("total"),
            F.sum(F.when(above, most_of).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("__weight"))).alias("weight"),
        ).first()
        if s["total"] is None or s["n"] == fixed or not s["weight"]:
            break
        level, fixed = (s["total"] - s["full"]) / s["weight"], s["n"]
    target = F.least(most_of, F.col("__weight") * F.lit(level or 0.0))
    return ranked.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("expected"))


def flight(p: np.ndarray, size: np.ndarray, open_at_end: int = 2) -> None:
    """Move the fractions p, in place and in order, until at most open_at_end lie between 0 and 1.

    Sums of p and of p * size stay as they are while three are open; then only that of p * size.
    """
    todo = np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist()[::-1]
    p_, s_ = p.tolist(), size.astype(float).tolist()
    rng = np.random.default_rng(zlib.crc32(np.concatenate([p, size.astype(float)]).tobytes()))  # coins of the block's content
    coin = rng.random(len(todo) + 8).tolist()
    hand: list[int] = []
    while len(hand) + len(todo) > open_at_end and len(hand) + len(todo) >= 3:
        while len(hand) < 3:
            hand.append(todo.pop())
        a, b, c = hand
        u = (s_[c] - s_[b], s_[a] - s_[c], s_[b] - s_[a])
        if not (u[0] or u[1]):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p_[i]) / x if x > 0 else p_[i] / -x for i, x in zip(hand, u, strict=True) if x)
        down = min(p_[i] / x if x > 0 else (1 - p_[i]) / -x for i, x in zip(hand, u, strict=True) if x)
        move = up if coin[len(todo) % len(coin)] * (up + down) < down else -down
        for i, x in zip(hand, u, strict=True):
            p_[i] += move * x
            if p_[i] < EPS:
                p_[i] = 0.0
            elif p_[i] > 1 - EPS:
                p_[i] = 1.0
        hand = [i for i in hand if 0.0 < p_[i] < 1.0]
    p[:] = p_


def land(p: np.ndarray, size: np.ndarray) -> None:
    """Set the open fractions, in place, to the subset whose words (then whose number) come nearest to the expected."""
    k = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(k):
        subset = (np.arange(2 ** len(k))[:, None] >> np.arange(len(k))) & 1
        off = np.abs(subset @ size[k] - p[k] @ size[k]) + 1e-6 * np.abs(subset.sum(1) - p[k].sum())
        p[k] = subset[np.argmin(off)]
    p[:] = np.round(p)


def _flight_of_block(last: bool):
    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__id", "size", "__row"], kind="stable")
        p, size = frame["__p"].to_numpy().copy(), frame["size"].to_numpy().astype(float)
        flight(p, size, LANDING if last else 2)
        if last:
            land(p, size)
        return frame.assign(__p=p)

    return fly


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """docs (a written table with doc_id, source and size) with source_size, target, copies and taken."""
    workers_import(docs.sparkSession)
    targets = cut(source_targets(docs.select(F.col(source).alias("source"), F.col(size).alias("size")), weights, most))
    small = targets.count() <= BROADCAST_SOURCES
    known = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), "target", "expected")
    out = docs.drop("source_size", "target", "expected", "copies", "taken").join(F.broadcast(known) if small else known, F.col(source).eqNullSafe(F.col("__source")), "left")
    out = out.withColumnRenamed("__source_size", "source_size").withColumns({
        "__whole": F.floor(F.col("expected") + EPS).cast("long"), "__row": F.monotonically_increasing_id(),
    }).withColumn("__p", F.greatest(F.col("expected") - F.col("__whole"), F.lit(0.0)))
    out = cut(out.drop("expected"))
    schema = "__source string, __id long, size long, __row long, __p double, __block long"
    moving = out.where(f"__p > {EPS} and `{size}` > 0").select(F.col("__source").cast("string"), F.col(doc_id).cast("long").alias("__id"), F.col(size).cast("long").alias("size"), "__row", "__p")
    settled: list[DataFrame] = []
    while True:
        largest = moving.groupBy("__source").agg(F.count(F.lit(1)).alias("__n"))
        most_open = largest.agg(F.max("__n")).first()[0] or 0
        last = most_open <= block
        blocks = largest.withColumn("__blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("__n") / block))).drop("__n")
        blocks = F.broadcast(blocks) if small else blocks
        salt = F.lit(0).cast("long")
        if not last:  # rows that repeat more often than a block holds are spread; any of them stands for the others
            often = moving.groupBy("__id", "size").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block).select(F.col("__id").alias("__i"), F.col("size").alias("__s"))
            moving = moving.join(often, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("size") == F.col("__s")), "left")
            salt = F.when(F.col("__s").isNotNull(), F.col("__row")).otherwise(salt)
        dealt = moving.withColumn("__salt", salt).join(blocks.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
        dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("__id", "size", "__salt"), F.col("__blocks"))).select("__source", "__id", "size", "__row", "__p", "__block")
        flown = cut(dealt.groupBy("__source", "__block").applyInPandas(_flight_of_block(last), schema))
        done = (F.col("__p") <= EPS) | (F.col("__p") >= 1 - EPS)
        settled.append(flown.where(done).select("__row", F.col("__p").alias("__one")))
        if last:
            break
        moving = flown.where(~done).drop("__block")
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    out = out.join(chosen.where("__one > 0.5").withColumnRenamed("__row", "__r"), F.col("__row") == F.col("__r"), "left")
    out = out.withColumn("copies", F.coalesce(F.col("__whole"), F.lit(0)) + F.col("__one").isNotNull().cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col(size)).drop("__source", "__whole", "__row", "__p", "__r", "__one")


def op3_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; the columns of docs stay."""
    rows = placed(docs)
    sized = cut(rows.select("__doc.doc_id", "__doc.source", n_words(F.col("__doc.text")).alias("size"), "__place"))
    copies = mix(sized).where("copies > 0").select(F.col("__place").alias("__taken"), "copies")
    taken = rows.join(copies, F.col("__place") == F.col("__taken"))
    return taken.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__doc.*")
