"""Byte-level BPE encoding of whole texts, and operator 5, the exact length histogram.

Ids are those of ``tokenizers`` for the vocabulary file at ``path`` with add_special_tokens=False. The
same vocabulary as ranks lets tiktoken produce the same ids several times faster; a text that
contains a special token's string, which ``tokenizers`` turns into that token, goes to ``tokenizers``
itself.

Operator 5 (exact length histogram): documents are aggregated by encoded length (partial sums before
the shuffle, so a length that a third of all documents share is one row per task), and running sums
over the distinct lengths give totals, quantiles and truncated totals for every context limit. The
running sums are two-level: within ranges of 1,024 lengths in parallel, and over one row per range.

Defined results: null and empty texts have length 0; repeated rows count each time; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, read, workers_import

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Lengths that share one first-level running sum.
RANGE = 1024


@functools.cache
def _reference(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, tuple(x.content for x in t.get_added_tokens_decoder().values())


@functools.cache
def _fast(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, path: str = PATH, ranks: str = RANKS) -> np.ndarray:
    """Ids of one text as uint32; null gives none."""
    if not text:
        return np.empty(0, np.uint32)
    reference, special = _reference(path)
    if any(x in text for x in special):
        return np.array(reference.encode(text, add_special_tokens=False).ids, np.uint32)
    return _fast(ranks).encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def lengths(docs: DataFrame, path: str = PATH, ranks: str = RANKS) -> DataFrame:
    """One row per row of docs: length (long), the number of ids of its text."""
    workers_import(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t, path, ranks)) for t in b.column(0).to_pylist()], pa.int64())], ["length"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length, with running sums on both sides.

    length, n_docs; docs_at_most, tokens_at_most: documents not longer and their tokens;
    docs_longer: the suffix sum; truncated_tokens: the corpus' tokens if each document is cut to
    length; share_at_most: docs_at_most over all documents.
    """
    exact = cut(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("__range", F.expr(f"length div {RANGE}")))
    ranges = exact.groupBy("__range").agg(F.sum("n_docs").alias("__d"), F.sum(F.col("length") * F.col("n_docs")).alias("__t"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of lengths
    everything = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    ranges = ranges.select("__range", F.coalesce(F.sum("__d").over(before), zero).alias("__d0"), F.coalesce(F.sum("__t").over(before), zero).alias("__t0"), F.sum("__d").over(everything).alias("__all"))
    inside = Window.partitionBy("__range").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = exact.join(ranges, "__range").withColumns({
        "docs_at_most": F.col("__d0") + F.sum("n_docs").over(inside),
        "tokens_at_most": F.col("__t0") + F.sum(F.col("length") * F.col("n_docs")).over(inside),
    })
    return out.select(
        "length", "n_docs", "docs_at_most", "tokens_at_most", (F.col("__all") - F.col("docs_at_most")).alias("docs_longer"),
        (F.col("tokens_at_most") + F.col("length") * (F.col("__all") - F.col("docs_at_most"))).alias("truncated_tokens"),
        (F.col("docs_at_most") / F.col("__all")).alias("share_at_most"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: truncated_tokens, the corpus' tokens when each document is cut to ``limit``; exact for any limit."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: length, the smallest with at least the share q of the documents not longer (null for no documents)."""
    return histogram.where(F.col("share_at_most") >= q).agg(F.min("length").alias("length"))


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(lengths(read(spark, sf_dir, "documents")))
