import re
from collections import Counter

import pytest
from cases import SCHEMA, awkward, docs
from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q
from tessera.llm import toxicity as T
from tessera.llm import url_rules as U


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x " * 40, "l1\nl1\n\nl2\n l1\nl1", "a|b ## é\x0bz\x0cq\r\nw", "one two three four five six seven eight nine " * 3 + "tail", "é\u00a0ü same", "q " * 7]


def test_metrics_match_brute_force(spark):
    texts = TEXTS + [r[1] for r in awkward()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in Q.measure(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "k", "p"), [(1, 0, 0.3), (50, 0, 0.05), (400, 1, 0.01), (5000, 30, 0.01), (200_000, 900, 0.005)])
def test_binomial_bound_is_exact(spark, n, k, p):
    import math

    exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    got = spark.range(1).select(F.expr(Q.binomial_cdf(f"{n}L", f"{k}L", p))).first()[0]
    assert got == pytest.approx(exact, rel=1e-7) if k < n * p else got == 1


def test_certified_cutoffs_reject_junk_and_keep_clean(spark):
    clean = [(k, " ".join(f"w{k}x{i}" for i in range(30)), "en") for k in range(3000)]
    junk = [(10_000 + k, " ".join(f"w{k}x{i}***" for i in range(30)), "en") for k in range(50)]
    few = [(20_000 + k, " ".join(f"v{k}x{i}***" for i in range(30)), "xx") for k in range(3)]
    df = spark.createDataFrame(clean + junk + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(3000)] + [(10_000 + k, 0) for k in range(50)] + [(20_000, 1)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in Q.quality_verdicts(df, labels).where("kept").collect()}
    assert kept == set(range(3000)) | {20_000, 20_001, 20_002}  # a stratum with one label certifies nothing


def test_copies_are_one_trial(spark):
    """1,000 rows of the same good text, some of one document, certify nothing; as many different texts do."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(k % 700, text, "en") for k in range(3000)], "doc_id long, text string, lang string")
    measured = Q.measure(df).select("doc_id", "lang", Q.content(), *Q.METRICS)
    labels = spark.createDataFrame([(k, 1) for k in range(700)], "doc_id long, quality int")
    assert {r[f"cut_{x}"] for r in Q.certify(measured, labels).collect() for x in Q.RULES} == {None}


def test_cutoffs_equal_exact_tests(spark):
    """5,000 good documents a language with a share of marks, stutter and repeats: every cutoff by exact binomial sums."""
    import math
    import random

    rng = random.Random(8)
    rows = []
    for k in range(10_000):
        w = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        if rng.random() < 0.002:
            w = [x + "**" for x in w]
        if rng.random() < 0.003:
            w[5:9] = [w[5]] * 4
        rows.append((k, " ".join(w), "en" if k % 2 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(k, 1) for k in range(10_000)], "doc_id long, quality int")
    measured = Q.cut(Q.measure(df).select("doc_id", "lang", Q.content(), *Q.METRICS))
    got = {r["stratum"]: [r[f"cut_{x}"] for x in Q.RULES] for r in Q.certify(measured, labels).collect()}
    values = measured.where(~Q.base_failed()).select("lang", *(m.alias(x) for x, m in Q.rule_metrics().items())).collect()
    p = Q.FALSE_REJECTION / len(Q.RULES)
    for lang in ("en", None):
        of = [r for r in values if r["lang"] == lang]
        n = len(of)
        for rule, cut in zip(Q.RULES, got[lang], strict=True):
            want = None
            for c in Q.CUTOFFS:
                k = sum(r[rule] > c for r in of)
                if math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) * 2 * len(Q.RULES) > Q.ALPHA:
                    break
                want = c
            assert cut == want, (lang, rule)
    assert {c for cuts in got.values() for c in cuts} - {None}


def test_quality_stage_keeps_columns_and_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.stage(spark, docs(spark), str(tmp_path))
    assert out.columns == docs(spark).columns
    rows = sorted(map(tuple, out.collect()), key=str)
    want = [r for r in awkward() if not (brute(r[1])[0] < 20 or 100 * brute(r[1])[4] > 30 * brute(r[1])[0])]
    assert rows == sorted(want, key=str)
    assert Q.stage(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_toxicity_finds_held_out_insults(spark):
    import random

    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(300)}"
    rows, labels = [], []
    for k in range(1500):
        w = [word() for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(["badword", "uglyword", "nastyword"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(90_000, None), (90_001, ""), (None, "badword " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = T.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).withColumn("held", T.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    wrong = [r for r in out if r["held"] and r["doc_id"] in truth and r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 5
    assert {r["predicted"] for r in out if r["doc_id"] in (90_000, 90_001)} == {0}
    assert T.toxicity(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert {r["score"] for r in T.toxicity(df.limit(3), spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_kneser_ney_matches_plain_counts(spark):
    """Both orders by plain dictionaries: probabilities of words in the tables, ratios of the others; copies of texts change nothing."""
    import random
    from collections import defaultdict

    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    word = lambda: f"w{min(rng.randrange(25), rng.randrange(25))}"
    rows = [(" ".join(word() for _ in range(rng.randint(1, 40))), k % 3 == 0) for k in range(60)] + [("", True), (None, False), ("One, two-THREE!", True)]
    rows += rows[:20]
    df = spark.createDataFrame([(t, int(c)) for t, c in rows], "text string, class int")
    model = T.kneser_ney(T.pair_counts(df, held=200))
    split = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", (t or "").lower()).split()
    triples = [set(), set()]
    for t, c in rows:
        w = ["", "", *split(t)]
        triples[c] |= {(w[i - 2], w[i - 1], w[i]) for i in range(2, len(w))}
    n, after, vocabulary = [Counter((h, w) for _, h, w in x) for x in triples], [], set()
    for x in n:
        after.append(Counter(w for _, w in x))
        vocabulary |= set(after[-1])
    total = sum(sum(a.values()) for a in after)
    shared = lambda w: (after[0][w] + after[1][w] + 1) / (total + len(vocabulary))
    single = lambda c, w: (max(after[c][w] - T.RARE, 0) + sum(min(x, T.RARE) for x in after[c].values()) * shared(w)) / sum(after[c].values())
    of = [defaultdict(dict), defaultdict(dict)]
    for c in (0, 1):
        for (h, w), k in n[c].items():
            of[c][h][w] = k

    def p(c, h, w):
        follow = of[c].get(h)
        if not follow:
            return single(c, w)
        return (max(follow.get(w, 0) - T.RARE, 0) + sum(min(k, T.RARE) for k in follow.values()) * single(c, w)) / sum(follow.values())

    texts = [t for t, _ in rows] + ["w1 w2 unseen w3 w1 unseen other", "two three one"]
    words, before, lengths = T.hashed(pa.array(texts, pa.string()))
    got, evidence = model.probabilities(words, before), model.evidence(words, before)
    plain = [(h, w) for t in texts for h, w in zip(["", *split(t)], split(t), strict=False)]
    assert lengths.tolist() == [len(split(t)) for t in texts] and len(plain) == len(words)
    known = np.isin(words, model.words)
    assert known.any() and not known.all()
    for k, (h, w) in enumerate(plain):
        if known[k]:
            assert got[:, k] == pytest.approx([p(0, h, w), p(1, h, w)])
        assert evidence[k] == pytest.approx(np.log(p(1, h, w) / p(0, h, w)))


def test_isotonic_curve(spark):
    """Of all rising curves (brute force over few places) none is nearer, and Spark's values are those between the knots."""
    import itertools
    import random

    import numpy as np

    rng = random.Random(5)
    for _ in range(30):
        z = np.array(sorted(rng.sample(range(100), 6)), float)
        y = np.array([rng.randint(0, 1) for _ in z], float)
        x, p = T.isotonic(z, y)
        mine = np.interp(z, x, p)
        levels = sorted({sum(y[i:j]) / (j - i) for i in range(6) for j in range(i + 1, 7)})
        best = min(sum((a - b) ** 2 for a, b in zip(c, y, strict=True)) for c in itertools.combinations_with_replacement(levels, 6))
        assert ((mine - y) ** 2).sum() <= best + 1e-9 and (np.diff(p) >= 0).all()
    x, p = T.isotonic(np.array([1.0, 1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    at = [-5.0, 1.0, 1.5, 2.0, 2.5, 3.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in at], "z double").coalesce(1).select(T.between(F.col("z"), x, p)).collect()]
    assert got == pytest.approx(np.interp(at, x, p).tolist())


def test_toxicity_on_awkward_rows(spark):
    """Clashing columns, long texts, repeated rows and null ids."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    out = T.toxicity(docs(spark).withColumns({"score": F.lit("x"), "class": F.lit("y"), "worst_1": F.lit(0)}), labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in awkward()) and all(0 <= r["score"] <= 1 for r in out)


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/x?q#f", None), (2, "http://example.com/en/", ""), (3, "http://a.net/fr/1", '<a href="http://b.org/x">'), (4, "http://b.org/", '<a href="//A.net/z">'), (5, None, None), (6, "no scheme", ""), (7, "http://com", ""), (8, "http://x.com?/en/", ""), (9, "s://a.net", ""), (3, "http://a.net/fr/1", None)]
    out = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {x for x in out if x[0] in (1, 2, 5, 6, 7, 8)} == {(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "com", "", None, "allow"), (8, "x.com", "", None, "allow")}
    # b.org links to a.net, two of whose three pages are blocked: distrust flows back to it
    assert (9, "a.net", "", None, "block") in out and (4, "b.org", "/", None, "block") in out
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def linked_pages():
    """Pages of many hosts with absolute links, a hub, hosts that are only linked to, rule-blocked pages and targets."""
    import random

    rng = random.Random(7)
    hosts = [f"h{k}.{rng.choice(('org', 'net', 'com', 'io'))}" for k in range(40)] + ["hub.io"]
    rows = []
    for k in range(300):
        host = rng.choice(hosts)
        path = rng.choice(("/es/1", "/fr/2", "/en/3", "/", "/de/4"))
        to = [rng.choice((*hosts, "hub.io", "hub.io", "gone.net", "lost.io")) for _ in range(rng.randint(0, 4))]
        html = "".join(f'<a href="{rng.choice(("http://", "//", "HTTPS://"))}{t}{rng.choice(("/es/9", "/fr/8", "/x"))}">' for t in to) + '<a href="/local">'
        rows.append((k, f"http://{host}{path}", html))
    return [*rows, (300, None, None), (301, "http://lone.io/x", ""), (301, "http://lone.io/x", "")]


def test_url_query_equals_its_sql_on_linked_pages(spark, tmp_path):
    from compare import differences

    folder = tmp_path / "sf"
    folder.mkdir()
    spark.createDataFrame(linked_pages(), "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    out = U.op8_link_graph_urls(spark, str(folder))
    assert differences(out, U.ORACLE_SQL.replace("FROM pages", f"FROM read_parquet('{folder}/pages.parquet/*.parquet')"), "/root/testdata/sf0.001") == []
    assert {r["verdict"] for r in out.where("rule is null").collect()} == {"allow", "block"}


def test_long_urls_and_pages(spark):
    long = "http://a.org/" + "x/" * 100_000
    links = "".join(f'<a href="http://h{k}.net/fr/{k}">' for k in range(3000)) + '<a href="' + "y" * 300_000 + '">'
    out = U.judge_urls(spark.createDataFrame([(1, long, links), (2, "://" * 50_000, None), (None, "http://a.org/q", links)], "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["host"], r["verdict"]) for r in out} == {(1, "a.org", "block"), (2, ":", "allow"), (None, "a.org", "block")}


def test_targets_without_pages_spread_distrust(spark):
    """The only evidence against a.org is that it links to a blocked page that was not crawled."""
    rows = [(1, "http://a.org/x", '<a href="http://gone.net/fr/1">'), (2, "http://b.org/x", '<a href="http://kept.io/1">')]
    out = {r["page_id"]: r["verdict"] for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "verdict": F.lit(2)})).collect()}
    assert out == {1: "block", 2: "allow"}


def test_propagation_matches_plain_loop(spark):
    import random

    rng = random.Random(2)
    hosts = [f"h{k}" for k in range(12)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): rng.randint(1, 5) for _ in range(40)}
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    seeds = [(h, rng.randint(0, 3), rng.randint(0, 3)) for h in hosts[:9]]
    out = {r["host"]: (r["trust"], r["distrust"]) for r in U.propagate(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, trusted long, blocked long"), rounds=4, tolerance=0.0, salts=3).collect()}
    trust, bad = {h: 0.0 for h in hosts} | {h: float(t) for h, t, _ in seeds}, {h: 0.0 for h in hosts} | {h: float(b) for h, _, b in seeds}
    t0, b0 = dict(trust), dict(bad)
    for _ in range(4):
        trust, bad = (
            {h: t0[h] + 0.85 * sum(n * trust[a] / sum(m for (x, _), m in edges.items() if x == a) for (a, b), n in edges.items() if b == h) for h in hosts},
            {h: b0[h] + 0.85 * sum(n * bad[b] / sum(m for (_, y), m in edges.items() if y == b) for (a, b), n in edges.items() if a == h) for h in hosts},
        )
    for h in out:
        assert out[h] == pytest.approx((trust[h], bad[h]))


def test_schema_of_cases():
    assert len(SCHEMA.split(",")) == len(awkward()[0])
