"""The registered queries over a whole small directory: SQL where there is some, plain Python otherwise."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import differences
from test_spans import pii_spans, secret_spans
from test_tokens_mixing import plain_targets
from tokenizers import Tokenizer

from tessera.llm import packing, tokens
from tessera.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in table("documents")}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), ORACLE_SQL[name], DATA) == []


def test_toxicity_query(spark, documents):
    out = QUERIES["op2_kneser_ney_toxicity"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(documents)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_mixing_query(spark, documents):
    out = QUERIES["op3_cube_mixing"](spark, DATA).collect()
    size = {k: len((r["text"] or "").encode().split()) for k, r in documents.items()}
    by = defaultdict(int)
    for k, r in documents.items():
        by[r["source"]] += size[k]
    target = plain_targets(by)
    taken = Counter()
    for r in out:
        source = documents[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[source] and r["target"] == pytest.approx(target[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert len(out) == len(documents) and all(abs(taken[s] - target[s]) <= 0.02 * sum(by.values()) for s in by)


@pytest.mark.parametrize(("name", "spans", "kinds"), [("op4_boosted_pii", pii_spans, ("email", "ip", "card", "phone")), ("op7_crf_secrets", secret_spans, ("assign", "access", "hex"))])
def test_span_queries(spark, documents, name, spans, kinds):
    out = QUERIES[name](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(documents)
    for r in out:
        base = [f"{k}:{a}:{b}" for a, b, k in spans(documents[r["doc_id"]]["text"] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in kinds] == [sum(x.startswith(f"{k}:") for x in base) for k in kinds]


def test_histogram_query(spark, documents):
    encode = Tokenizer.from_file(tokens.PATH).encode
    n = Counter(len(encode(r["text"] or "", add_special_tokens=False).ids) for r in documents.values())
    assert {r["length"]: r["n_docs"] for r in QUERIES["op5_length_histogram"](spark, DATA).collect()} == n


def test_packing_query(spark, documents):
    encode = Tokenizer.from_file(tokens.PATH).encode
    want = Counter()
    for k, r in documents.items():
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at = packing.cut_points(len(ids), 1024)
        want.update((k, p, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)))
    out = QUERIES["op6_best_fit_packing"](spark, DATA).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()] and sum(n for _, n in p) <= 1024
    total = sum(r["length"] for r in out)
    assert len(places) <= 1.05 * total / 1024 + 2
