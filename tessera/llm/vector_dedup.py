"""Operator 9, embedding near-duplicates by product quantisation with certified probes.

Vectors are scaled to length 1, where cosine >= t means distance <= r = sqrt(2 - 2 t). A coarse
quantiser (lists) and, for the residuals, a codebook per subspace are fitted on at most SAMPLE vectors
chosen by a hash; every vector is indexed: its list, its codes and the exact distance to what they
stand for. A vector probes each list that can hold a neighbour: by the triangle inequality, the list's
farthest member must be within r of it, and so must the bisector between its own centroid and the list's.
In a probed list, asymmetric distances come from lookup tables; a member stays a candidate if its
asymmetric distance is at most r plus its own quantisation error, again the triangle inequality, so no
link is lost. Candidates are reranked by the exact cosine in double precision.

Only vectors with equal labels (and lengths) meet. Equal vectors are first merged into one that
carries their number. Quantisers have 1, 2, 4, ... lists; a label takes the one whose lists hold about BLOCK of its
vectors, so that a vector is sent to few lists (in many dimensions an isolated one must probe a fixed share of all
lists, whatever their number). Lists grow beyond BLOCK only where the sample supports no more of them. A list of one
label is dealt over blocks of about BLOCK members and its probing vectors over blocks of the same size; vectors of
floats travel as floats and are scaled where they are compared. A task compares two blocks and returns a number of links per
vector and a spanning forest of the links, never the pairs.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components, and those
with a null label, have no links and are their own component; repeated rows link with each other;
rows with a null vec_id keep a null component if alone; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tessera.llm.common import cut, read, workers_import
from tessera.llm.graph import components, forest

COSINE = 0.93
SAMPLE = 20_000
#: Sampled vectors for each list of the largest quantiser.
FOR_LIST = 16
SUBSPACES = 8
CODES = 128
BLOCK = 2000
SLACK = 1e-6
#: Labels of which the levels are sent to every executor; beyond, Spark chooses the join.
BROADCAST_LABELS = 50_000


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


@dataclass
class Quantiser:
    """centroids (k, d); codebooks: one (codes, d_s) per subspace, in order of the components."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
        centroids = k_means(x, lists)
        residual = x - centroids[nearest(x, centroids)]
        return cls(centroids, [k_means(part, codes) for part in np.array_split(residual, min(subspaces, x.shape[1]), axis=1)])

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([b.shape[1] for b in self.codebooks])[:-1].tolist()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and distance to the vector that they stand for."""
        at = nearest(x, self.centroids)
        parts = np.split(x - self.centroids[at], self.cuts, axis=1)
        codes = np.column_stack([nearest(p, b) for p, b in zip(parts, self.codebooks, strict=True)]).astype(np.uint8)
        error = sum(((p - b[codes[:, k]]) ** 2).sum(1) for k, (p, b) in enumerate(zip(parts, self.codebooks, strict=True)))
        return at, codes, np.sqrt(error)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of list at, by table lookup."""
        out = np.zeros((len(queries), len(codes)))
        for k, (q, b) in enumerate(zip(np.split(queries - self.centroids[at], self.cuts, axis=1), self.codebooks, strict=True)):
            table = (q**2).sum(1)[:, None] - 2 * q @ b.T + (b**2).sum(1)
            out += table[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: np.ndarray, r: float) -> Iterator[np.ndarray]:
        """For each x of list own: the lists from its own on that can hold a vector within r."""
        for i in range(0, len(x), 1024):
            part, o = x[i : i + 1024], own[i : i + 1024]
            d2 = np.maximum((part**2).sum(1)[:, None] - 2 * part @ self.centroids.T + (self.centroids**2).sum(1), 0)
            between = np.sqrt(np.maximum(((self.centroids[o][:, None] - self.centroids[None]) ** 2).sum(2), 0))
            bisector = (d2 - d2[np.arange(len(o)), o][:, None]) <= 2 * between * (r + SLACK)
            near = bisector & (np.sqrt(d2) <= r + radius + SLACK) & (np.arange(len(self.centroids)) >= o[:, None])
            near[np.arange(len(o)), o] = True
            for row in near:
                yield np.flatnonzero(row)


def unit(values: pa.Array, size: int) -> np.ndarray:
    return scaled(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def link_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id long, embedding array of float or double, label) with n_links, component_id and kept."""
    workers_import(vectors.sparkSession)
    r = math.sqrt(2 - 2 * cosine)
    # floats and their squares stay in the range of doubles and travel as they are
    floats = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if floats else "<f8"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if floats else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"), F.monotonically_increasing_id().alias("__row"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # squares of very small or large doubles leave their range: scale by the largest
    value = F.col("embedding") if floats else F.expr("transform(embedding, x -> x / array_max(transform(embedding, y -> abs(y))))")
    rows = cut(rows.withColumn("embedding", F.when(usable, value)))
    classes = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("__row").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("size", F.size("embedding"))
    classes = cut(classes)
    # a label's quantiser has 2 ** level lists
    most_lists = max(1, sample // FOR_LIST)
    level = F.floor(F.log2(F.greatest(F.lit(1.0), F.least(F.lit(float(most_lists)), F.col("m") / block)))).cast("int")
    labels = cut(classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("m")).select(F.col("label").alias("of"), F.col("size").alias("long"), level.alias("level"), "m"))
    total, many = labels.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count(F.lit(1))).first()
    known = labels.drop("m")
    classes = classes.join(F.broadcast(known) if many <= BROADCAST_LABELS else known, (F.col("label") == F.col("of")) & (F.col("size") == F.col("long"))).drop("of", "long")
    share = min(1.0, sample / max(total, 1))
    chosen = classes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * share)).select("size", "embedding").toArrow()
    model: dict[tuple[int, int], Quantiser] = {}
    for size, at in sorted((x["long"], x["level"]) for x in labels.select("long", "level").distinct().collect()):  # vector lengths by at most log2(sample) levels
        of = chosen.filter(pa.compute.equal(chosen.column("size"), size)).column("embedding").combine_chunks()
        if len(of):
            model[size, at] = Quantiser.fit(unit(of, size), 2**at)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def quantiser(size: int, at: int) -> Quantiser:
        # a length that the sample misses gets one list and no codes; bounds hold all the same
        return sent.value.get((size, at)) or Quantiser(np.zeros((1, size)), [np.zeros((1, size))])

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (size, at), part in frame.groupby(["size", "level"]):
                raw = np.stack(part["embedding"].to_numpy()).astype(kind)
                x = scaled(raw)
                q = quantiser(size, at)
                near, codes, error = q.encode(x)
                far = np.sqrt(((x - q.centroids[near]) ** 2).sum(1))
                yield part.drop(columns="embedding").assign(unit=[row.tobytes() for row in raw], list=near, codes=[row.tobytes() for row in codes], error=error, far=far)

    indexed = cut(classes.select("label", "size", "level", "node", "n", "embedding").mapInPandas(index, "label string, size int, level int, node long, n long, unit binary, list long, codes binary, error double, far double"))
    radius: dict[tuple[int, int], np.ndarray] = {}
    for row in indexed.groupBy("size", "level", "list").agg(F.max("far").alias("far")).collect():  # a row for each list of the quantisers
        radius.setdefault((row["size"], row["level"]), np.full(2 ** row["level"], -2 * r - 2))[row["list"]] = row["far"]
    reach = vectors.sparkSession.sparkContext.broadcast(radius)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (size, at), part in frame.groupby(["size", "level"]):
                q = quantiser(size, at)
                x = scaled(np.stack([np.frombuffer(u, kind) for u in part["unit"]]))
                lists_of = [p.tolist() for p in q.probes(x, part["list"].to_numpy(), reach.value[size, at][: len(q.centroids)], r)]
                yield part[["label", "size", "level", "node", "n", "unit"]].assign(home=part["list"], probes=lists_of)

    probed = indexed.select("label", "size", "level", "node", "n", "unit", "list").mapInPandas(probe, "label string, size int, level int, node long, n long, unit binary, home long, probes array<long>")
    probed = cut(probed)
    probes = probed.select("label", "size", "level", "node", "n", "unit", "home", F.explode("probes").alias("list"))
    key = ["label", "size", "list"]
    deal = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    blocks = deal(indexed, "member_blocks").join(deal(probes, "query_blocks"), key)
    blocks = cut(blocks)
    member = indexed.select(*key, "level", "node", "n", "unit", "codes", "error").join(blocks, key).withColumn("mb", F.pmod(F.xxhash64("node"), F.col("member_blocks")))
    member = member.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
    query = probes.join(blocks, key).withColumn("qb", F.pmod(F.xxhash64("node"), F.col("query_blocks")))
    query = query.withColumn("mb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("member_blocks") - 1)))
    columns = [*key, "level", "mb", "qb", "node", "n", "unit", "home", "codes", "error"]
    none = {"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")}
    both = member.withColumn("home", F.lit(-1).cast("long")).select(*columns).unionByName(query.withColumns(none).select(*columns))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        q, m = frame[frame["home"] >= 0], frame[frame["home"] < 0]
        if not len(m) or not len(q):
            return pd.DataFrame({"a": pd.array([], "Int64"), "b": pd.array([], "Int64"), "links": pd.array([], "Int64")})
        size, at = int(frame["size"].iloc[0]), int(frame["list"].iloc[0])
        x, y = (scaled(np.stack([np.frombuffer(u, kind) for u in part["unit"]])) for part in (q, m))
        codes = np.stack([np.frombuffer(u, np.uint8) for u in m["codes"]])
        node, other = q["node"].to_numpy(), m["node"].to_numpy()
        candidate = quantiser(size, int(frame["level"].iloc[0])).distances(x, at, codes) <= r + m["error"].to_numpy() + SLACK
        # two vectors of one list meet from both sides and count once
        candidate &= (q["home"].to_numpy() < at)[:, None] | (node[:, None] < other)
        i, j = np.nonzero(candidate)
        exact = np.concatenate([(x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)] or [np.empty(0)]) >= cosine
        i, j = i[exact], j[exact]
        links = [np.bincount(i, weights=m["n"].to_numpy()[j], minlength=len(x)), np.bincount(j, weights=q["n"].to_numpy()[i], minlength=len(y))]
        kept = forest(node[i], other[j])
        counts = pd.DataFrame({"a": np.concatenate([node, other]), "links": np.concatenate(links).astype(np.int64)})
        edges = pd.DataFrame({"a": node[i][kept], "b": other[j][kept], "links": np.zeros(len(kept), np.int64)})
        return pd.concat([counts[counts["links"] > 0], edges]).astype("Int64")[["a", "b", "links"]]

    met = cut(both.groupBy(*key, "mb", "qb").applyInPandas(compare, "a long, b long, links long"))
    joined = components(met.where("b is not null").select("a", "b")).withColumnRenamed("component", "root")
    links = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_class = of_class.select(F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    found = rows.join(of_class, (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding")), "left")
    found = cut(found.select("vec_id", F.coalesce("root", "__row").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")))
    smallest = found.groupBy(F.col("root").alias("__root")).agg(F.min("vec_id").alias("component_id"))
    out = found.join(smallest, F.col("root") == F.col("__root"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op9_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {COSINE}),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) x ON x.a = v.vec_id JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) y ON y.a = v.vec_id
"""
