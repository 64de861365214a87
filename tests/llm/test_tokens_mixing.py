import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import awkward, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing as M
from tessera.llm import packing as P
from tessera.llm import tokens as K


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(K.PATH)


def test_ids_equal_tokenizers(reference):
    texts = [r[1] or "" for r in awkward()] + ["<|endoftext|> in text", "naïve ßtraße  \n\n\t 你好 🙂", "\u2028x\u00a0y", "a" * 3000]
    for t in texts:
        assert K.encode(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_histogram(spark, reference):
    n = [len(reference.encode(r[1] or "", add_special_tokens=False).ids) for r in awkward()]
    h = K.length_histogram(K.lengths(docs(spark)))
    rows = h.collect()
    assert {r["length"]: r["n_docs"] for r in rows} == {x: n.count(x) for x in n}
    for r in rows:
        assert r["docs_at_most"] == sum(x <= r["length"] for x in n) and r["docs_longer"] == sum(x > r["length"] for x in n)
        assert r["tokens_at_most"] == sum(x for x in n if x <= r["length"]) and r["truncated_tokens"] == sum(min(x, r["length"]) for x in n)
    for limit in (0, 17, 500, 10**6):
        assert K.truncated_total(h, limit).first()[0] == sum(min(x, limit) for x in n)
    assert K.quantile(h, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert K.length_histogram(K.lengths(docs(spark, []))).count() == 0


def test_packing_round_trip(spark, reference):
    rows = awkward()
    pieces = P.pieces(docs(spark, rows), with_ids=True)
    packed = P.pack(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "ids"), block=20).collect()
    by = defaultdict(list)
    for r in packed:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    # every document's ids, as often as its row occurs, from pieces that follow one another; rows of one id, and of none, too
    want = Counter((r[0], tuple(ids[i:j]), i) for r in rows for ids in [[*reference.encode(r[1] or "", add_special_tokens=False).ids, 2]] for cut in [P.cut_points(len(ids), 1024)] for i, j in zip(cut, cut[1:], strict=False))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["start"]) for r in packed) == want
    assert all((r["start"] == 0) == (r["piece"] == 0) for r in packed)
    assert P.pack(P.pieces(docs(spark, []))).count() == 0


def test_cut_points():
    assert P.cut_points(1024, 1024) == [0, 1024] and P.cut_points(1025, 1024) == [0, 1, 1025] and P.cut_points(2048, 1024) == [0, 1024, 2048] and P.cut_points(1, 1024) == [0, 1]


@pytest.mark.parametrize("seed", range(5))
def test_local_search_only_improves(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(200, 700, 300)
    bins = P.best_fit(sizes, 1024)
    better = P.local_search([list(b) for b in bins], sizes, 1024)
    assert sorted(i for b in better for i in b) == list(range(300)) and all(sizes[b].sum() <= 1024 for b in better)
    squares = lambda bs: sum(int(sizes[b].sum()) ** 2 for b in bs)
    assert len(better) <= len(bins) and squares(better) >= squares(bins)


@pytest.mark.parametrize("seed", range(4))
def test_local_search_ends_where_no_step_is_left(seed):
    """Brute force over all pairs of underfull bins: no move and no exchange raises the squares; more bins than the window."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(120, 900, 260)
    bins = P.local_search(P.best_fit(sizes, 1024), sizes, 1024, width=3)
    fill = [int(sizes[b].sum()) for b in bins]
    if len(bins) == -(-int(sizes.sum()) // 1024):
        return
    for a, x in enumerate(bins):
        for b, y in enumerate(bins):
            if a != b and fill[a] <= fill[b] < 1024:
                for i in x:
                    for back in [0, *(int(sizes[j]) for j in y), *(int(sizes[j] + sizes[k]) for n, j in enumerate(y) for k in y[n + 1 :])]:
                        gain = int(sizes[i]) - back
                        assert not (gain > 0 and fill[b] + gain <= 1024), (a, b, i, back)


def test_local_search_empties_bins_that_first_fit_left():
    sizes = np.array([6, 4, 5, 5, 3, 3, 4])
    assert len(P.local_search([[0], [1], [2], [3], [4, 5], [6]], sizes, 10)) == 3


def plain_targets(sizes):
    keys = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, target, free = sum(sizes.values()), {}, set(keys)
    rest = total
    while free:
        w = sum(weight[k] for k in free)
        over = [k for k in free if rest * weight[k] / w > 3 * sizes[k]]
        if not over:
            target |= {k: rest * weight[k] / w for k in free}
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            free.discard(k)
        rest = total - sum(target.values())
    return target


@pytest.mark.parametrize("block", [7, 5000])
def test_mix_meets_targets(spark, block):
    rows = docs(spark).select("doc_id", "source", M.n_words(F.col("text")).alias("size"))
    out = M.mix(M.cut(rows), block=block).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
    target = plain_targets(sizes)
    assert len(out) == len(awkward())
    for s in sizes:
        of = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) for r in of)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in of)
        assert abs(sum(r["taken"] for r in of) - target[s]) <= max(30, 0.5 * max(r["size"] for r in of))
    again = M.mix(M.cut(rows), block=block).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert M.mix(M.cut(docs(spark, []).select("doc_id", "source", M.n_words(F.col("text")).alias("size")))).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(3)
    p, size = np.full(500, 0.37), np.array([rng.randint(1, 900) for _ in range(500)], float)
    before = p.sum(), p @ size
    M.flight(p, size)
    assert ((p > M.EPS) & (p < 1 - M.EPS)).sum() <= 2 and p.sum() == pytest.approx(before[0]) and p @ size == pytest.approx(before[1])


def test_mixing_stage_repeats_rows(spark, tmp_path):
    out = M.stage(spark, docs(spark), "")
    assert out.columns == docs(spark).columns and set(map(str, out.collect())) <= set(map(str, docs(spark).collect()))
    assert M.stage(spark, docs(spark, []), "").count() == 0
