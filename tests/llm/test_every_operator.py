"""Odd, empty and all-null tables through every query; rows out as each docstring says."""
import duckdb
import pytest

import corpus_pipeline
from feedspark.llm.queries import ORACLE, QUERIES

from .conftest import SCHEMAS, odd_documents, odd_pages

PER_DOCUMENT = [n for n in QUERIES if n.split("_")[0] in ("op1", "op3", "op5", "op6", "op7", "op9", "op13")]


def rows(df):
    names = sorted(df.columns)
    return sorted(str([r[c] for c in names]) for r in df.collect())


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", QUERIES)
def test_null_tables(spark, null_dir, name):
    got = QUERIES[name](spark, null_dir).collect()
    assert len(got) == (0 if name.startswith(("op2_", "op4_", "op11_", "op12_")) else 3)


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_for_every_row(spark, odd_dir, name):
    got = QUERIES[name](spark, odd_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_documents())


def test_one_row_for_every_page(spark, odd_dir):
    got = QUERIES["op8_url_filter"](spark, odd_dir).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r["page_id"]) for r in odd_pages())


@pytest.mark.parametrize("name", ["op7_license_scan", "op8_url_filter", "op11_centroid_prefix_trie"])
@pytest.mark.parametrize("folder", ["odd_dir", "empty_dir", "null_dir", "sf"])
def test_against_sql(spark, request, name, folder):
    d = request.getfixturevalue(folder)
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    out = con.execute(ORACLE[name])
    names = [c[0] for c in out.description]
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in out.fetchall())
    assert rows(QUERIES[name](spark, d)) == want


@pytest.mark.parametrize("folder,count", [("empty_dir", 0), ("null_dir", None), ("odd_dir", None)])
def test_pipeline_stages_on_odd_tables(spark, request, tmp_path, folder, count):
    d = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    if count is not None:
        assert docs.count() == count
