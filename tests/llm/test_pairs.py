import math
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, docs, groups, sets
from pyspark.sql import functions as F

from tessera.llm import jaccard_join as J
from tessera.llm import vector_dedup as V
from tessera.llm.graph import components, forest


def jaccard(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def check_components(spark, rows, **how):
    out = J.jaccard_components(spark, docs(spark, rows), **how).collect()
    of = [sets(r[1]) for r in rows]
    root = groups(of, jaccard)
    want = []
    for k, r in enumerate(rows):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == root[k] and rows[i][0] is not None]
        want.append((str(r[0]), len(of[k]), str(min(ids)) if of[k] and ids else str(r[0])))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == sorted(want)


def test_components_match_brute_force(spark):
    check_components(spark, awkward())


def test_components_of_small_lots(spark):
    """Lists of which the members come from many lots and ranges."""
    check_components(spark, awkward(90, 4), held=40, group=3)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_polynomial_hashes_confuse(spark):
    rows = []
    for n in (512, 1024, 2048, 4096):
        word = thue_morse(n)
        rows += [(len(rows), word, "en", "a", n, "1", "x", None), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")), "en", "a", n, "1", "x", None)]
    # words of one length that differ in one byte or in the order of eight-byte parts, and a word that is another's beginning
    for word in ("x" * 64, "x" * 63 + "y", "x" * 65, "abcdefgh" * 2 + "z" * 8, "abcdefgh" + "z" * 8 + "abcdefgh", "abcdefgh", "abcdefg", "abcdefghi", "abcdefgh\x00", "X" * 64):
        rows.append((len(rows), word, "en", "a", 1, "1", "x", None))
    check_components(spark, rows)


@pytest.mark.parametrize(("few", "held"), [(0, 3), (0, 10**6), (50, 7)])
def test_components_by_stars(spark, few, held):
    """The way of large tables: rounds of stars with centres dealt over salts, long paths too."""
    rng = random.Random(few + held)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, 1000) for k in range(1001, 1200)] + [(2000 + k, 2001 + k) for k in range(50)] + [(None, 3), (7, 7)]
    linked = {frozenset(e) for e in edges}
    at = groups(nodes := sorted({x for e in edges if None not in e and e[0] != e[1] for x in e}), lambda a, b: frozenset((a, b)) in linked)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4), few, 3, held).collect()}
    assert got == {n: min(m for m, b in zip(nodes, at, strict=True) if b == a) for n, a in zip(nodes, at, strict=True)}


@pytest.mark.parametrize("length", [6, 11, 13, 22, 40, 150])
def test_components_of_near_copies_by_size(spark, length):
    """Chains of edits around each size class and the light boundary; a large group in which most pairs do not link."""
    rng = random.Random(length)
    words = [f"x{k}" for k in range(500)]
    rows, k = [], 0
    for _ in range(4):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(30):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, length // 30))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            if rng.random() < 0.4:
                edited = edited[: len(edited) - rng.randint(0, max(1, length // 12))]
            rows.append((k, " ".join(edited), "en", "a", 1, "1", "x", None))
            k += 1
            if rng.random() < 0.2:
                base = edited
    check_components(spark, rows)


def test_signatures_meet_for_every_link():
    """Two sets that link share a signature, at all sizes and both sides of the boundary."""
    rng = np.random.default_rng(9)
    for light in (0, 9, 17):
        for n in list(range(1, 45)) + [60, 99, 100, 101, 140, 333, 700]:
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for drop in range(0, len(a) // 10 + 1):
                for add in range(0, (100 * (len(a) - drop) - 90 * len(a)) // 90 + 1):
                    b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - drop]], rng.integers(0, 2**63, add, dtype=np.uint64)]))
                    if J.linked(a, b):
                        assert np.intersect1d(J.signatures([a], light)[0], J.signatures([b], light)[0]).size, (n, drop, add, light)


def test_boundary_weighs_cost():
    assert J.boundary({5: 1000}) >= 5 and J.boundary({500: 10}) <= J.MOST_LIGHT and J.boundary({}) == 0


def test_shingles_equal_python_sets():
    texts = [r[1] for r in awkward()] + ["A b\x0bc\x0cd", "é É", "x" * 100]
    found = J.shingles(pa.array(texts, pa.string()))
    assert [len(s) for s in found] == [len(sets(t)) for t in texts]
    names = {}
    for t, s in zip(texts, found, strict=True):
        assert names.setdefault(s.tobytes(), sets(t)) == sets(t)


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_hashing_in_blocks(block):
    data = np.frombuffer(("one two  three" + "x" * 30 + "\n" + "four" + " " * 9 + "five").encode(), np.uint8)
    for borders in ([0, len(data)], [0, 0, 3, 5, 16, 16, 40, len(data)], [0, 1, 2, len(data), len(data)]):
        want, got = J.word_hashes(data, np.array(borders)), J.word_hashes(data, np.array(borders), block)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_link_matrix():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64)
    several = [np.unique(np.concatenate([base[: 50 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in range(8)]
    assert (J.link_matrix(several) == np.array([[J.linked(a, b) for b in several] for a in several])).all()


def test_jaccard_stage_keeps_one_of_each_group(spark):
    rows = awkward()
    out = J.stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark).columns
    kept = out.collect()
    of = [sets(r[1]) for r in rows]
    root = groups(of, jaccard)
    assert len(kept) == len({root[k] for k in range(len(rows)) if of[k]}) + sum(not s for s in of)
    assert J.stage(spark, docs(spark, []), "").count() == 0


def near_copies():
    """Documents with copies cut, extended or edited so that many link at five words and 80 % but not at three and 90 %, and short ones."""
    rng = random.Random(12)
    words = [f"y{k}" for k in range(600)]
    several = [[rng.choice(words) for _ in range(n)] for n in (3, 4, 5, 7, 9, 12, 20, 30, 45, 60, 90, 150, 400)]
    texts = []
    for base in several:
        n = len(base)
        texts += [base, base[: n - n // 8], base[: n - n // 5], base + [rng.choice(words) for _ in range(n // 7)]]
        for edits in (1, max(1, n // 50), max(1, n // 45), max(2, n // 30)):
            edited = list(base)
            for _ in range(edits):
                edited[rng.randrange(n)] = rng.choice(words)
            texts.append(edited)
    return [(k, " ".join(x), "en", "a", 1, "1", "x", None) for k, x in enumerate(texts)]


def test_jaccard_stage_at_five_words_and_80_percent(spark):
    rows = near_copies()
    of = [sets(r[1], 5) for r in rows]
    root = groups(of, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    strict = groups([sets(r[1]) for r in rows], jaccard)
    assert len(set(root)) < len(set(strict))
    kept = {r["doc_id"] for r in J.stage(spark, docs(spark, rows), "").collect()}
    assert kept == {rows[k][0] for k in set(root)}


@pytest.mark.parametrize("light", [0, 6, 12])
def test_signatures_meet_for_every_link_at_80_percent(light):
    rng = np.random.default_rng(10)
    for n in [*range(1, 45), 60, 99, 140, 333]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for drop in range(0, len(a) // 5 + 1, 1 if n < 45 else 7):
            for add in range(0, (100 * (len(a) - drop) - 80 * len(a)) // 80 + 1, 1 if n < 45 else 7):
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - drop]], rng.integers(0, 2**63, add, dtype=np.uint64)]))
                if J.linked(a, b, 80):
                    assert np.intersect1d(J.signatures([a], light, 80)[0], J.signatures([b], light, 80)[0]).size, (n, drop, add, light)


def test_lists_of_large_names(spark):
    """Names of nodes near the end of the range, of which the sum leaves a long even after a shift by 8 bits; two lists hold the same nodes; groups of 20."""
    names = [2**63 - 1 - k for k in range(300)]
    several = {x: np.array([k // 2, 1000 + k // 2, 2000 + k // 2], np.uint64) for k, x in enumerate(names)}
    members = spark.createDataFrame([(at, x, names[-1]) for at in (1, 2) for x in names], "list long, node long, pivot long")
    known = spark.createDataFrame([(x, len(s), bytearray(J.bitmap(s).tobytes())) for x, s in several.items()], "node long, n long, bits binary")
    sets = spark.createDataFrame([(x, bytearray(s.tobytes())) for x, s in several.items()], "node long, shingles binary")
    more = J.open_pairs(members, spark.createDataFrame([], "node long, component long"), known, group=20)
    got = {tuple(sorted((r["a"], r["b"]))) for r in J.compare_clusters(components(more), sets, group=20).collect()}
    assert got == {(names[k + 1], names[k]) for k in range(0, 300, 2)}


def test_bitmaps_exclude_no_link():
    """The bound holds for sets of all sizes, folded ones too, and excludes sets that have little in common."""
    rng = np.random.default_rng(4)
    for n in (1, 5, 31, 33, 64, 65, 250, 3000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for drop in (0, 1, n // 10, n // 5, n // 2, n):
            for add in (0, 1, n // 8, n, 3 * n):
                other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
                if len(other):
                    x, y = J.bitmap(base), J.bitmap(other)
                    least = min(len(x), len(y))
                    apart = int(np.bitwise_count(J.folded(x, least) ^ J.folded(y, least)).sum())
                    assert apart <= len(np.setxor1d(base, other))
                    for percent in (80, 90):
                        assert J.may_link(len(base), len(other), apart, percent) or not J.linked(base, other, percent)
    far = [np.unique(rng.integers(0, 2**63, 250, dtype=np.uint64)) for _ in range(40)]
    lot = ([J.bitmap(x) for x in far], np.full(40, 250), np.arange(40))
    assert len(J.candidates(lot, lot, 80)[0]) == 0 and len(J.candidates(lot, (lot[0], lot[1], lot[2] + 40), 80)[0]) == 40


def test_frequent_shingles_come_last(spark):
    """A passage that all documents share is counted as frequent, and nothing changes but the lists."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:10]] + [passage + f" {k}" for k in range(20)]
    rows = [(k, t, "en", "a", 1, "1", "x", None) for k, t in enumerate(texts)]
    frequent = J.frequent_shingles(spark, docs(spark, rows).select("doc_id", "text", "source"), len(rows))
    assert set(J.shingles(pa.array([passage]))[0].tolist()) <= set(frequent.tolist()) and len(frequent) < 200
    s = J.shingles(pa.array(texts[:60]))
    names = {int(x) for c in range(60) for x in J.mix(J.mix(frequent + J._K[6]) + np.uint64(c))}
    assert names & {int(x) for x in J.signatures(s, 0, 90)[0]} and not names & {int(x) for x in J.signatures(s, 0, 90, frequent)[0]}
    check_components(spark, rows)


@pytest.mark.parametrize("held", [2_000, J.HELD])
def test_frequent_shingles_are_counted_over_all_documents(spark, held):
    """More documents than a sample once held: passages of a few of them are found, and each place in the order follows the whole count."""
    passages = {n: pa.array([f"r{n} s{n} t{n}"]) for n in (2, 3, 4, 7, 40)}
    texts = [f"u{k} v{k} w{k}" for k in range(12_000)]
    for at, (n, passage) in enumerate(passages.items()):
        for k in range(n):
            texts[(at + 1) * 37 + k * 251] = passage[0].as_py()
    rows = [(k, t, "en", "a", 1, "1", "x", None) for k, t in enumerate(texts)]
    frequent = J.frequent_shingles(spark, docs(spark, rows).select("doc_id", "text", "source"), len(rows), held=held)
    assert frequent.tolist() == [int(J.shingles(passages[n])[0][0]) for n in (40, 7, 4, 3)]


@pytest.mark.parametrize("frequent", [0, 40])
def test_signatures_meet_whatever_is_frequent(frequent):
    rng = np.random.default_rng(frequent)
    pool = rng.integers(0, 2**63, 80, dtype=np.uint64)
    common = pool[:frequent]
    for n in (10, 20, 45, 70):
        for percent in (80, 90):
            for _ in range(60):
                a = np.unique(rng.choice(pool, n))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - rng.integers(0, 3)]], rng.choice(pool, rng.integers(0, 3))]))
                if J.linked(a, b, percent):
                    assert np.intersect1d(J.signatures([a], 5, percent, common)[0], J.signatures([b], 5, percent, common)[0]).size


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1400)] + [(2000 + k, 2001 + k) for k in range(60)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            at[b] = a
    assert got == {n: root(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert forest(np.array([1, 2, 1]), np.array([2, 3, 3])) == [0, 1]


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = []
    for k in range(400):
        v = centres[rng.integers(20)] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.3])
        rows.append((k, v.tolist(), int(rng.integers(3))))
    rows += [(500 + k, rows[0][1], rows[0][2]) for k in range(30)]  # copies
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None] * 8, 1), (603, [float("nan")] * 16, 1), (604, [float("inf")] * 16, 1), (605, rows[0][1], None), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (608, [], 1), (609, [1e-300] * 16, 2), (610, [1e300] * 16, 2), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = lambda v, l: v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)  # noqa: E731, E741

    def close(a, b):
        if not (usable(*a[1:]) and usable(*b[1:])) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
        return x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93

    root = groups(rows, close)
    want = sorted((r[0], sum(close(r, s) for j, s in enumerate(rows) if j != k), min(rows[i][0] for i in range(len(rows)) if root[i] == root[k])) for k, r in enumerate(rows))
    for block, sample in ((40, 150), (10, 1000), (1000, 150)):
        out = V.link_vectors(df.withColumns({"n": F.lit("x"), "list": F.lit(0)}), block=block, sample=sample).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert V.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_floats_match_brute_force(spark):
    """Floats, of lengths far from 1 too, are compared in double precision; repeated rows link."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    rows = [(k, ((centres[k % 12] + rng.normal(size=24) * rng.choice([0.05, 0.28])) * 10.0 ** int(rng.integers(-30, 30))).astype(np.float32).tolist(), int(k % 2)) for k in range(260)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    same = np.array([[a[2] == b[2] for b in rows] for a in rows]) & (x @ x.T >= 0.93) & ~np.eye(len(rows), dtype=bool)
    out = V.link_vectors(df, block=30).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in out) == sorted((r[0], int(same[k].sum())) for k, r in enumerate(rows))
