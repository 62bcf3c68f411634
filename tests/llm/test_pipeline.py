"""The pipeline on the smallest table: every stage keeps what it must and does what it is for."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from kinspark.llm.common import documents
from kinspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import words_of


def test_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_check(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = db.execute(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, sf_dir).toArrow()
    columns = sorted(expected.column_names)
    assert columns == sorted(got.column_names)
    pairs = [Counter(zip(*(t.column(c).to_pylist() for c in columns))) for t in (got, expected)]
    assert pairs[0] == pairs[1]


def test_stages(spark, sf_dir, stage, none):
    docs = documents(spark, sf_dir)
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(stage.save(name, step(spark, tables[-1], sf_dir)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:]))
    texts = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]

    def shingles(text):
        w = words_of((text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    before, after = ({i: shingles(t) for i, t in x.items()} for x in texts[1:3])
    for i, a in after.items():
        assert not any(j < i and 100 * len(a & b) >= 80 * len(a | b) for j, b in after.items())
    for i in before.keys() - after.keys():
        assert any(100 * len(before[i] & b) >= 80 * len(before[i] | b) for j, b in before.items() if j != i)
    assert len(texts[3]) == len(texts[2])
    packed = tables[-1].collect()
    assert max(r.offset + r.length for r in packed) <= 2048


@pytest.mark.parametrize("step", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, none, step):
    assert step(spark, none.drop("key", "n"), "").count() == 0
