"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from treeflow.llm import op2_secrets, registry


def test_stages_filter_and_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            left = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert left <= ids and len(left) > len(ids) / 2
            ids = left
    assert not any(op2_secrets.spans(r["text"] or "", op2_secrets.default_vocabulary()) for r in docs.collect())
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_twin(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    twin = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in twin.description]
    df = __spark_entry__.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, twin.fetchall()))


EDGES = "doc_id long, text string, lang string, source string, n_chars long, hub string, rows long"


def _stages(spark, docs, sf, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_stages_on_edge_cases(spark, sf, tmp_path):
    good = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"] and len(r["text"].split()) > 30][:3]
    long = " ".join(good) * 2000
    rows = [(1, None), (2, ""), (3, " \n"), (4, good[0]), (4, good[0]), (5, good[0]), (None, good[0]), (None, good[0]), (6, good[1]), (6, good[2]), (7, good[2]), (8, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", 1) for i, t in rows], EDGES)
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"] and r["text"].strip())
    assert kept == sorted([(4, good[0]), (0, good[0]), (0, good[0]), (6, min(good[1], good[2])), (8, long)])
    assert {r["doc_id"] for r in out.collect() if not (r["text"] or "").strip()} == {1, 2, 3}
    found = _stages(spark, docs, sf, tmp_path)
    assert all(d.columns == docs.columns for d in found[:-1])


def test_stages_on_an_empty_table(spark, sf, tmp_path):
    found = _stages(spark, spark.createDataFrame([], EDGES), sf, tmp_path)
    assert all(d.count() == 0 for d in found)
