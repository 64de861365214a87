"""Operator 1, quality rules with certified cutoffs [native: DataFrame and SQL functions only].

Every text gets four rule metrics (per mille of its words or characters; higher is worse). A rule's
cutoffs form a fixed sequence from lenient to strict. For each stratum (language) the labelled good
documents that pass the base rules are a holdout, one trial for each doc_id and one for each text (near
copies still count each): with n of them and k above a cutoff, the cutoff is
certified if P(Bin(n, eps) <= k) <= alpha / (strata * rules), i.e. if the exact (Clopper-Pearson)
upper bound of the false-rejection rate is at most eps. Cutoffs are tested in order and the first
failure ends the sequence, so the family-wise error over all strata, rules and cutoffs is at most
alpha: fixed-sequence testing inside a rule, Bonferroni across rules and strata. eps is the total
budget per stratum divided by the number of rules.

Defined results: a null or empty text has no words, so it is base_failed and not kept; a stratum
without enough good labels has no certified cutoff and rejects nothing beyond the base rules; a null
language is a stratum of its own; documents with several or null labels count as good only if
the largest quality is 1; repeated rows are judged row by row; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, placed, read, words

RULES = ("symbols", "dup_lines", "repeats", "stutter")
CUTOFFS = (900, 700, 500, 400, 300, 200, 150, 100, 75, 50, 30, 20, 10)
FALSE_REJECTION = 0.02
ALPHA = 0.05
#: Strata of which the cutoffs are sent to every executor; beyond, Spark chooses the join.
BROADCAST_STRATA = 20_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the long columns METRICS. All columns of docs stay; equal names are replaced.

    n_repeat_words: chained 64-bit hashes of 8-word windows only prove that nothing repeats; a text
    with equal hashes is decided by its windows as strings.
    """
    w, lines, h, h2, h4, h8, again = (F.col(f"__{x}") for x in ("w", "lines", "h", "h2", "h4", "h8", "again"))
    chain = lambda a, k: F.zip_with(a, F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__w", words(F.col(text)))
    out = out.withColumns({
        "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "__h": F.transform(w, lambda x: F.xxhash64(x)),
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long"),
    })
    out = out.withColumn("__h2", chain(h, 1)).withColumn("__h4", chain(h2, 2)).withColumn("__h8", F.slice(chain(h4, 4), 1, F.greatest(F.size(w) - 7, F.lit(0))))
    out = out.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stutter": F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, i - 1) == x))).cast("long"),
        # windows with their places in order of content, only where hashes say that something may repeat
        "__again": F.when(
            F.size(F.array_distinct(h8)) < F.size(h8),
            F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 8), lambda i: F.struct(F.array_join(F.slice(w, i + 1, 8), " ").alias("s"), i.alias("i")))),
        ),
    })
    places = F.array_sort(F.transform(
        F.filter(again, lambda x, j: F.coalesce((j > 0) & (F.get(again, j - 1)["s"] == x["s"]), F.lit(False)) | F.coalesce(F.get(again, j + 1)["s"] == x["s"], F.lit(False))),
        lambda x: x["i"],
    ))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(8), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("__w", "__lines", "__h", "__h2", "__h4", "__h8", "__again")


def content(text: str = "text") -> Column:
    """Digest of a text, null and empty alike."""
    return F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_metrics() -> dict[str, Column]:
    """Per mille, rounded down, by rule; 0 where there is nothing to divide by."""
    part = lambda a, b: F.coalesce(F.expr(f"(1000 * {a}) div nullif({b}, 0)"), F.lit(0))
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "stutter": part("n_stutter", "n_words")}


def _lgamma(x: str) -> str:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8."""
    y = f"({x} + 8D)"
    product = " * ".join(f"({x} + {i}D)" for i in range(8))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12 * {y}) - 1D / (360 * pow({y}, 3)) + 1D / (1260 * pow({y}, 5)) - ln({product}))"


def binomial_cdf(n: str, k: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k), right where it is below a half (k < n p); 1 elsewhere.

    Terms are summed downwards from k; beyond 60 standard deviations they are below e^-1800.
    """
    log_top = f"{_lgamma(f'({n} + 1D)')} - {_lgamma(f'({k} + 1D)')} - {_lgamma(f'({n} - {k} + 1D)')} + {k} * ln({p!r}D) + ({n} - {k}) * ln({1 - p!r}D)"
    terms = f"aggregate(sequence(0L, least({k}, cast(60 * sqrt({n} * {p!r}D) + 200 as bigint))), named_struct('t', 1D, 's', 0D), (a, j) -> named_struct('t', a.t * ({k} - j) * {(1 - p) / p!r}D / ({n} - {k} + j + 1), 's', a.s + a.t), a -> a.s)"
    return f"(case when {n} > 0 and {k} < {n} * {p!r}D then exp({log_top}) * {terms} else 1D end)"


def certify(measured: DataFrame, labels: DataFrame, stratum: str = "lang", *, budget: float = FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """One row per stratum: stratum, and for each rule cut_<rule> (int; null: no certified cutoff).

    measured: doc_id, the stratum, the columns METRICS and content (a digest of the text); labels: doc_id, quality.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("__quality")).where("__quality = 1 and doc_id is not null")
    rows = measured.where(~base_failed()).join(good, "doc_id").select("doc_id", "content", F.col(stratum).alias("stratum"), *(m.alias(r) for r, m in rule_metrics().items()))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("content", "stratum", *RULES)).alias("one")).select("one.*")
    holdout = one.dropDuplicates(["stratum", "content"])
    counts = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.array(*(F.count_if(F.col(r) > c) for c in CUTOFFS)).alias(f"__{r}") for r in RULES))
    strata = measured.select(F.col(stratum).alias("stratum")).distinct()
    counts = counts.withColumn("m", F.lit(len(RULES)) * F.expr("count(1) over ()"))
    cuts = F.array(*map(F.lit, CUTOFFS))
    # number of cutoffs before the first that fails its test
    passed = lambda r: F.expr(f"coalesce(nullif(array_position(transform(__{r}, k -> {binomial_cdf('n', 'k', budget / len(RULES))} * m <= {alpha!r}D), false), 0), {len(CUTOFFS) + 1}) - 1").cast("int")
    counts = counts.select("stratum", *(passed(r).alias(f"__{r}") for r in RULES))
    counts = counts.select("stratum", *(F.when(F.col(f"__{r}") > 0, F.get(cuts, F.col(f"__{r}") - 1)).alias(f"cut_{r}") for r in RULES))
    found = counts.select("stratum", *(f"cut_{r}" for r in RULES))
    return strata.join(found, strata["stratum"].eqNullSafe(found["stratum"]), "left").select(strata["stratum"], *(f"cut_{r}" for r in RULES))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with base_failed, failed_rules (array) and kept. cutoffs: a written table from certify()."""
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    known = cutoffs.select(F.col("stratum").alias("__stratum"), *(F.col(f"cut_{r}").alias(f"__cut_{r}") for r in RULES))
    out = measured.join(known, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    failed = F.array_compact(F.array(*(F.when(m > F.col(f"__cut_{r}"), F.lit(r)) for r, m in rule_metrics().items())))
    out = out.withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__stratum", *(f"__cut_{r}" for r in RULES))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, METRICS, base_failed, failed_rules and kept for each row of docs."""
    measured = cut(measure(docs.select("doc_id", stratum, "text")).select("doc_id", stratum, content(), *METRICS))
    return judge(measured, cut(certify(measured, labels, stratum)), stratum).drop("content")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the columns of docs stay."""
    labels = read(spark, sf_dir, "labels")
    rows = placed(docs)
    # texts are measured once; what was measured is written without them and finds its rows again by their places
    measured = cut(measure(rows.select("__place", "__doc.doc_id", "__doc.lang", "__doc.text")).select("__place", "doc_id", "lang", content(), *METRICS))
    kept = judge(measured, cut(certify(measured, labels))).where("kept").select(F.col("__place").alias("__kept"))
    return rows.join(kept, F.col("__place") == F.col("__kept"), "left_semi").select("__doc.*")


_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_MILLE = {"symbols": "n_symbols, word_chars", "dup_lines": "n_dup_lines, n_lines", "repeats": "n_repeat_words, n_words", "stutter": "n_stutter, n_words"}
ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_W} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, lang, md5(text) AS content, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  (SELECT count(*) FROM (SELECT unnest(generate_series(2, len(w))) AS i) WHERE w[i] = w[i-1])::BIGINT AS n_stutter
  FROM l LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(f'coalesce((1000 * {a}) // nullif({b}, 0), 0) AS {r}' for r, (a, b) in ((r, x.split(', ')) for r, x in _MILLE.items()))} FROM m),
g AS (SELECT * FROM (SELECT b.* FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY content, lang NULLS FIRST) = 1)
  QUALIFY row_number() OVER (PARTITION BY lang, content) = 1),
t AS ({' UNION ALL '.join(f"SELECT lang, '{r}' AS rule, {i} AS i, {c} AS c, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM g GROUP BY lang" for r in RULES for i, c in enumerate(CUTOFFS))}),
p AS (SELECT lang, rule, i, c, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({FALSE_REJECTION / len(RULES)!r}) + (n - j) * ln(1 - {FALSE_REJECTION / len(RULES)!r}))) AS cdf
  FROM (SELECT *, unnest(generate_series(0, k)) AS j FROM t) GROUP BY ALL),
f AS (SELECT lang, rule, i, c, cdf * {len(RULES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM g)) <= {ALPHA} AS ok FROM p),
q AS (SELECT lang, rule, min(c) AS cutoff FROM f WHERE i < coalesce((SELECT min(i) FROM f AS x WHERE NOT ok AND x.rule = f.rule AND x.lang IS NOT DISTINCT FROM f.lang), 99) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f"coalesce({r} > (SELECT max(cutoff) FROM q WHERE rule = '{r}' AND q.lang IS NOT DISTINCT FROM b.lang), false)" for r in RULES)}) AS kept
FROM b
"""
