import importlib
import os

import pytest

import __spark_entry__
import corpus_pipeline
from tidewright.llm import bpe, lines, toxicity
from tidewright.llm.catalogue import QUERIES

from .test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_hold_what_they_promise(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.toxicity_stage(spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.tag(docs, toxicity.trained(docs, labels, ~toxicity.held_out()), spans=False).collect()}
    assert {r.doc_id for r in first.collect()} == {i for i in before if scores[i] < 0.7}
    assert first.schema == docs.schema

    second = corpus_pipeline.line_dedup_stage(spark, first, SF).cache()
    assert second.schema == docs.schema
    seen = [lines.normalised(x) for r in second.collect() for x in r.text.split("\n")]
    seen = [x for x in seen if x]
    assert len(seen) == len(set(seen)) and all(r.n_chars == len(r.text) for r in second.collect())

    third = corpus_pipeline.near_dedup_stage(spark, second, SF).cache()
    want = brute([(r.doc_id, r.text) for r in second.collect()])
    assert {r.doc_id for r in third.collect()} == {i for i, (_, _, kept) in want.items() if kept}

    fourth = corpus_pipeline.mixing_stage(spark, third, SF).cache()
    counts = {}
    for r in fourth.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert fourth.schema == docs.schema and set(counts) <= {r.doc_id for r in third.collect()} and max(counts.values()) <= 2

    fifth = corpus_pipeline.byte_bpe_stage(spark, fourth, SF)
    texts = {r.doc_id: r.text for r in fourth.collect()}
    rows = bpe.decode(fifth).collect()
    assert len(rows) == fourth.count() and all(bytes(r.decoded).decode() == texts[r.doc_id] and r.n_tokens == len(r["ids"]) for r in rows)


def test_run_goes_through_all_stages(spark, docs, prose, tmp_path):
    rows = [(i, "\n".join(prose(10 * i + k, 25) for k in range(3)), f"s{i % 3}") for i in range(30)] + [(100, prose(0, 25), "s0"), (101, None, None), (102, "", "s1")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(30)) and 30 <= len(out) <= 60


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_an_operator():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert {"pipeline", *names} <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, files in os.walk(f"{root}/tidewright"):
        if "/llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    assert "tidewright.llm" not in open(f"{folder}/{name}").read()
    importlib.reload(__spark_entry__)


@pytest.mark.parametrize("name", ["op10_norm_sorted_search"])
def test_oracle(spark, name):
    import duckdb

    from tidewright.llm.catalogue import ORACLES

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == sorted(con.execute(ORACLES[name]).fetchall())
