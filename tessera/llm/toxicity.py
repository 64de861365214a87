"""Operator 2, toxicity by class-conditional Kneser-Ney models.

Words are lower-cased runs without ASCII punctuation, by 64-bit hash. From labelled rows each class (toxic,
ordinary) gets an interpolated Kneser-Ney bigram model. A pair of words counts by the number of different
words before it, and a word by the number of different words it follows (continuation counts, so copies of a
passage add nothing); each count is discounted by up to RARE. What the discount frees in the
pairs of a word goes to the class's own words, and what it frees there to continuation counts that both
classes share. An expression rare in both classes therefore has the same likelihood in both, up to a constant.
A document's evidence is the difference of the two log-likelihoods per word, over the whole text and over its
worst windows of WINDOWS words (so a long text does not dilute a short insult), always divided by the
length. A logistic curve and then a rising one (isotonic regression), fitted on labelled rows that the counts have not
seen, turn them into a score from 0 to 1.

Only what differs from the shared counts is kept to score with (Model): words and pairs counted above RARE
in a class, and the words with such pairs. All other words and pairs have the same likelihood in both
classes up to the classes' constants, so nothing is lost. Bounds: the models are fitted on at most about
LABELLED labelled rows (documents chosen by a hash of doc_id; the labels of these are what is
broadcast), and their tables grow with what these rows hold. Counting is a partial aggregation per task before each shuffle.

Defined results: null and empty texts have no evidence and get the curve's value at 0; documents with
null or several labels are toxic if any label is 1; doc_id null counts as unlabelled and not held
out; without labelled rows of both classes every score is 0; repeated rows are scored row by row; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, mix, read, workers_import
from tessera.llm.words import KEYS, buffer_of, word_hashes

LABELLED = 200_000
WINDOWS = (1, 4, 16)
#: Discount of a continuation count: a class that has a word or a pair in so few contexts only trusts what it backs off to.
RARE = 3
#: Ranges of first words and of words in which counts meet.
RANGES = 128
COUNTS = ["range", "words", "u0", "u1", "h", "w", "n0", "n1", "first", "t0", "t1", "f0", "f1"]
THRESHOLD = 0.7
FEATURES = ("mean_evidence", *(f"worst_{k}" for k in WINDOWS))
#: Other ASCII than letters and digits to a space.
_PLAIN = np.array([i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)], np.uint8)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of texts (int64), the one before each (0 at the start of a text), and the number of words of each text."""
    data, borders = buffer_of(texts)
    words, first = word_hashes(_PLAIN[data], borders)
    words = words.view(np.int64)
    before = np.zeros_like(words)
    before[1:] = words[:-1]
    n = np.diff(first)
    before[first[:-1][n > 0]] = 0
    return words, before, n


@dataclass
class Model:
    """Two classes, 0 ordinary and 1 toxic. Tables are sorted by their keys (int64); rows of values by class.

    own: weight of what is left of a word's count; shared: the rest, by which the shared probability counts;
    left: of a pair's count, divided by that of its first word; rest: what the first word leaves to single words.
    """

    words: np.ndarray
    own: np.ndarray  # (2, words)
    shared: np.ndarray  # (words,) shared probability
    freed: tuple[float, float]
    pairs: np.ndarray
    left: np.ndarray  # (2, pairs)
    firsts: np.ndarray
    rest: np.ndarray  # (2, firsts)
    unseen: float  # shared probability of a word that is not in the table; it cancels

    def probabilities(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """p(word | the word before, class), by class; of words outside the tables up to a factor that the classes share."""
        at, known = _find(self.words, words)
        single = np.where(known, self.shared[at] if len(self.shared) else 0.0, self.unseen)
        p = np.stack([np.where(known, self.own[c][at], 0.0) + self.freed[c] * single if len(self.words) else self.freed[c] * single for c in (0, 1)])
        at, known = _find(self.firsts, before)
        if known.any():
            k = np.flatnonzero(known)
            p[:, k] *= self.rest[:, at[k]]
            pair, same = _find(self.pairs, pair_key(before[k], words[k]))
            p[:, k[same]] += self.left[:, pair[same]]
        return p

    def evidence(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) for each word."""
        p = self.probabilities(words, before)
        return np.log(p[1] / p[0])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(mix(before.view(np.uint64) + KEYS[0]) ^ words.view(np.uint64)).view(np.int64)


def _blobs(key: int, *arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([key], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def pair_counts(labelled: DataFrame, rare: int = RARE, held: int = 1_000_000) -> DataFrame:
    """labelled (text, class) to counts as packed arrays; written. Rows with words hold, for a range of words, how many words each follows in
    either class (a part of the whole from each range of first words); the others hold the pairs counted above ``rare`` and the first words of such pairs.

    A pair counts by the number of different words before it. A task sorts up to ``held`` words at a time;
    they meet by ranges of the pair's first word, of which there are RANGES, as the labelled rows are bounded.
    """
    workers_import(labelled.sparkSession)
    wide = np.uint64(2**64 // RANGES)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, w, before = _distinct(*np.concatenate(lots, axis=1))
            border = np.searchsorted(h // wide, np.arange(RANGES + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(border)).tolist():
                part = slice(border[k], border[k + 1])
                yield pa.RecordBatch.from_arrays(_blobs(k, h[part], w[part], before[part].astype(np.uint32)), ["range", "h", "w", "before"])

        for b in batches:
            words, first, n = hashed(b.column(0))
            earlier = np.zeros_like(words)
            earlier[1:] = first[:-1]
            earlier[first == 0] = 0
            cls = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64), n)
            # what stands before a pair, by 31 bits of its hash, and the class
            lots.append(np.stack([first.view(np.uint64), words.view(np.uint64), mix(earlier.view(np.uint64)) >> np.uint64(33) << np.uint64(1) | cls]))
            size += len(words)
            if size > held:
                yield from flush()
                lots, size = [], 0
        if size:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        h, w, before = _distinct(_column(table, "h", "<u8"), _column(table, "w", "<u8"), _column(table, "before", "<u4").astype(np.uint64))
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]))))
        toxic = np.add.reduceat((before & np.uint64(1)).astype(np.int64), new)
        n = np.stack([np.diff(np.append(new, len(h))) - toxic, toxic])
        h, w = h[new], w[new]
        kept = (n > rare).any(0)
        of = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        t, f = (np.stack([np.add.reduceat(x[c], of) for c in (0, 1)]) for x in (n, np.minimum(n, rare)))
        some = (f < t).any(0)
        none = np.empty(0, np.int64)
        rows = [_blobs(-1, none, none, none, h[kept], w[kept], n[0, kept], n[1, kept], h[of][some], t[0, some], t[1, some], f[0, some], f[1, some])]
        x, inverse = np.unique(w, return_inverse=True)
        u = [np.bincount(inverse, n[c] > 0, len(x)).astype(np.int32) for c in (0, 1)]
        border = np.searchsorted(x // wide, np.arange(RANGES + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(border)).tolist():
            part = slice(border[k], border[k + 1])
            rows.append(_blobs(k, x[part], u[0][part], u[1][part], *[none] * 9))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(row, COUNTS) for row in rows])

    lots = labelled.select(F.col("text").cast("string"), F.col("class").cast("long")).mapInArrow(triples, "range long, h binary, w binary, before binary")
    return cut(lots.groupBy("range").applyInArrow(count, "range long, " + ", ".join(f"{c} binary" for c in COUNTS[1:])))


def _distinct(h: np.ndarray, w: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows in order."""
    order = np.lexsort((before, w, h))
    h, w, before = h[order], w[order], before[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (before[1:] != before[:-1])
    return h[new], w[new], before[new]


def kneser_ney(counts: DataFrame, rare: int = RARE) -> Model:
    """Models from pair_counts."""
    above = counts.where("range < 0").drop("words", "u0", "u1").toArrow()  # what labelled rows, at most LABELLED, hold more than ``rare`` times
    pairs = {c: _column(above, c, "<i8") for c in ("h", "w", "n0", "n1")}
    firsts = {c: _column(above, c, "<i8") for c in ("first", "t0", "t1", "f0", "f1")}
    kept = np.unique(pairs["w"])
    sent = counts.sparkSession.sparkContext.broadcast(kept)

    def meet(table: pa.Table) -> pa.Table:
        x, inverse = np.unique(_column(table, "words", "<i8"), return_inverse=True)
        u = np.stack([np.bincount(inverse, _column(table, f"u{c}", "<i4"), len(x)).astype(np.int64) for c in (0, 1)])
        some = (u > rare).any(0) | np.isin(x, sent.value)
        totals = [len(x), *u.sum(1).tolist(), *np.minimum(u, rare).sum(1).tolist()]
        return pa.table({"w": pa.array([*x[some].tolist(), None], pa.int64()), **{f"u{c}": pa.array([*u[c, some].tolist(), None], pa.int64()) for c in (0, 1)}, "totals": pa.array([None] * int(some.sum()) + [totals], pa.list_(pa.int64()))})

    met = counts.where("range >= 0").select("range", "words", "u0", "u1").groupBy("range").applyInArrow(meet, "w long, u0 long, u1 long, totals array<long>").toArrow()
    sent.destroy()
    totals = np.array([x for x in met.column("totals").to_pylist() if x] or [[0] * 5]).sum(0).tolist()
    kinds, seen, freed = totals[0], totals[1:3], totals[3:5]
    known = met.filter(pa.compute.is_valid(met.column("w")))
    column = lambda t, c: t[c] if isinstance(t, dict) else t.column(c).to_numpy().astype(np.int64)
    order = np.argsort(column(known, "w"))
    u = np.stack([column(known, f"u{c}")[order] for c in (0, 1)])
    own = np.stack([np.maximum(u[c] - rare, 0) / max(seen[c], 1) for c in (0, 1)])
    by_first = np.argsort(column(firsts, "first"))
    t, f = (np.stack([column(firsts, f"{x}{c}")[by_first] for c in (0, 1)]) for x in "tf")
    h = column(firsts, "first")[by_first]
    key = pair_key(column(pairs, "h"), column(pairs, "w"))
    by_key = np.argsort(key)
    at = np.searchsorted(h, column(pairs, "h")[by_key])
    left = np.stack([np.maximum(column(pairs, f"n{c}")[by_key] - rare, 0) / np.maximum(t[c][at], 1) for c in (0, 1)])
    return Model(
        column(known, "w")[order], own, (u.sum(0) + 1) / (sum(seen) + max(kinds, 1)), tuple(freed[c] / seen[c] if seen[c] else 1.0 for c in (0, 1)),
        key[by_key], left, h, np.where(t > 0, f / np.maximum(t, 1), 1.0), 1 / (sum(seen) + max(kinds, 1)),
    )


def isotonic(z: np.ndarray, y: np.ndarray, most: int = 64) -> tuple[list[float], list[float]]:
    """Knots of the rising curve nearest to y over z (pooled neighbours), of which at most about ``most`` are kept."""
    blocks: list[list[float]] = []
    for v, label in sorted(zip(z.tolist(), y.tolist(), strict=True)):
        blocks.append([v, v, label, 1])
        while len(blocks) > 1 and (blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3] or blocks[-2][1] == blocks[-1][0]):
            low, high, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + total, blocks[-1][3] + n]
    if 2 * len(blocks) > most:
        blocks = [blocks[k] for k in np.unique(np.linspace(0, len(blocks) - 1, most // 2).astype(int))]
    x, p = [], []
    for low, high, total, n in blocks:
        x += [low] if low == high else [low, high]
        p += [total / n] * (1 if low == high else 2)
    return x, p


def between(z: Column, x: list[float], p: list[float]) -> Column:
    """Values of the curve through knots, level beyond its ends."""
    out = F.when(z <= x[0], F.lit(p[0]))
    for a, b, u, v in zip(x, x[1:], p, p[1:], strict=False):
        out = out.when(z <= b, F.lit(u) + (z - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(p[-1]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant last) by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_words and FEATURES (evidence per word, of the text and of its worst windows) after its other columns; text goes."""
    spark = docs.sparkSession
    workers_import(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("text", *FEATURES, "n_words")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                words, before, n = hashed(part.column(part.num_columns - 1))
                sums = np.concatenate(([0.0], np.cumsum(sent.value.evidence(words, before))))
                end = np.cumsum(n)
                start = end - n
                mean = (sums[end] - sums[start]) / np.maximum(n, 1)
                worst = np.zeros((len(WINDOWS), len(n)))
                some = n > 0
                if some.any():
                    # windows that begin at each word, cut at the end of its text
                    first = np.arange(len(words))
                    for k, width in enumerate(WINDOWS):
                        last = np.minimum(first + width, np.repeat(end, n))
                        worst[k, some] = np.maximum.reduceat(sums[last] - sums[first], start[some]) / width
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n), pa.array(mean), *map(pa.array, worst)], [*kept, "n_words", *FEATURES])

    source = docs.select(*kept, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(score, f"{schema}, n_words long, " + ", ".join(f"{x} double" for x in FEATURES))


def sample_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, class (0 or 1) of all labelled documents outside the held-out third, or of about ``most`` by a hash of doc_id."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("class"))
    rows = cut(rows)
    count = rows.count()
    return rows if count <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / count)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, n_words, FEATURES, score and predicted for each row of docs."""
    known = sample_labels(labels, most)
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0
    text = docs.select("doc_id", "text")
    counts = pair_counts(text.join(F.broadcast(known.where(~calibrates)), "doc_id").select("text", "class"))
    scored = cut(evidence(text, kneser_ney(counts)))
    seen = scored.join(F.broadcast(known.where(calibrates)), "doc_id").select(*FEATURES, "class").toArrow()
    x, y = np.column_stack([seen.column(k).to_numpy() for k in FEATURES]), seen.column("class").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        w = _logistic((x - mean) / scale, y)
        w = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()).tolist()
        line = sum((F.lit(a) * F.col(k) for a, k in zip(w, FEATURES, strict=False)), F.lit(w[-1]))
        # the logistic curve orders what is level on the other one
        score = 0.999 * between(line, *isotonic(x @ np.array(w[:-1]) + w[-1], y)) + 0.001 / (1 + F.exp(-line))
    else:
        score = F.lit(0.0)
    return scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_words", *FEATURES)
