import os
import re
import subprocess
import sys
import time
from collections import Counter

import corpus_pipeline
from cases import sets
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tessera.llm import mixing, quality_rules, tokens
from tessera.llm.common import ROOT, forget, shared_folder
from tessera.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_registry():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES} and len(QUERIES) == 10 and set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        tables.append(docs.collect())
    raw, good, single, clean, mixed, packed = tables
    # quality: a sub-multiset; what is long, plain and unrepeated stays
    assert not Counter(map(str, good)) - Counter(map(str, raw))
    # near-duplicates: no two of what stays link, and each that went links with something
    of = {r["doc_id"]: sets(r["text"], 5) for r in good}
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    left = [r["doc_id"] for r in single]
    assert not any(link(of[a], of[b]) for i, a in enumerate(left) for b in left[:i])
    assert all(any(link(of[r["doc_id"]], of[x]) for x in of if x != r["doc_id"]) for r in good if r["doc_id"] not in set(left))
    # secrets: the same documents without them
    assert sorted(r["doc_id"] for r in clean) == sorted(left)
    assert not any(re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r["text"]) for r in clean)
    # mix: whole documents, at most three times
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= mixing.MOST and {r["doc_id"] for r in mixed} <= set(left)
    total = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert abs(total(mixed) - total(clean)) < 0.05 * total(clean)
    # packing: every id of every copy, no sequence too long
    reference = Tokenizer.from_file(tokens.PATH)
    n = Counter()
    for r in mixed:
        n[r["doc_id"]] += len(reference.encode(r["text"], add_special_tokens=False).ids) + 1
    got, fill = Counter(), Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert got == n and max(fill.values()) <= 1024


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_quality_stage_leaves_no_copy_of_the_texts(spark, tmp_path):
    tables = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("table-")}
    before = tables()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    quality_rules.stage(spark, docs.union(docs), DATA).write.parquet(f"{tmp_path}/twice")  # each row is judged, copies too
    assert len(tables() - before) == 1  # what is not a table of files is written first
    before = tables()
    quality_rules.stage(spark, docs, DATA).write.parquet(f"{tmp_path}/out")
    assert tables() == before
    out, twice = (Counter(map(str, spark.read.parquet(f"{tmp_path}/{x}").collect())) for x in ("out", "twice"))
    assert out and twice == out + out


def test_shuffle_files_of_finished_steps_go_at_once(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles().mkString("\n").split("\n")
        return {x.rsplit("/", 1)[-1] for x in found if "/shuffle_" in x}

    forget(spark)
    before = shuffles()
    spark.range(1000).selectExpr("id % 7 as id").groupBy("id").applyInArrow(lambda t: t, "id long").toArrow()
    assert shuffles() - before
    forget(spark)
    time.sleep(0.5)  # files are removed in the background
    assert not shuffles() - before


def test_tasks_give_back_their_memory():
    """A task frees many small blocks between a few that stay; the process holds little more than before."""
    code = """
import re
import numpy as np, pyarrow as pa
from tessera.llm.common import lean
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
kept = []
def work(batches):
    for b in batches:
        blocks = [np.ones(12_000) for _ in range(1000)]
        kept.append(np.ones(1000))
        yield b
for lap in (work, lean(work)):
    list(lap(iter([pa.record_batch({"x": pa.array([1])})])))
    print(held())
"""
    plain, given = map(int, subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())
    assert given < plain - 50
