"""Every query against its SQL twin, and what the plans must not hold."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.plans.QUERIES, entry.plans.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda x: Counter(repr(tuple(r)) for r in x)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


#: What needs strict JSON, Python syntax or a random choice has no SQL; tests/test_protocol.py holds it to plain code.
NO_SQL = {"audit_response", "code_parses", "extract_code", "inject_bug", "pass_discipline", "pending_call", "quality_totals", "raw_audit"}


def test_what_has_no_sql_gives_rows(spark):
    assert set(QUERIES) - set(SQL) == NO_SQL
    for name in NO_SQL:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4 * spark.read.parquet(f"{SF}/benchmark.parquet").count()


@pytest.mark.parametrize(("name", "key", "table", "id"), [("tfidf_topk_all", "item_id", "benchmark", "item_id"), ("memory_block_all", "item_id", "benchmark", "item_id"), ("dense_topk_all", "query", "embeddings", "vec_id"), ("hit_label_all", "query", "embeddings", "vec_id"), ("label_counts_all", "query", "embeddings", "vec_id")])
def test_all_rows_are_searched_for(spark, name, key, table, id):
    asked = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(id).collect()}
    assert {r[0] for r in QUERIES[name](spark, SF).select(key).collect()} == asked


def test_all_documents_and_runs_have_rows(spark):
    n = lambda table, id: spark.read.parquet(f"{SF}/{table}.parquet").select(id).distinct().count()
    assert QUERIES["ngram_overlap_all"](spark, SF).count() == n("documents", "doc_id")
    assert QUERIES["multi_run_all"](spark, SF).select("run").distinct().count() == n("events", "event_type") > 2


def test_documents_are_tokenised_once(spark, monkeypatch):
    from tessera.operators import memory

    plans = []
    stored = memory.stored
    monkeypatch.setattr(memory, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    plans.append(QUERIES["tfidf_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("Generate explode") for p in plans) == 2  # documents, and the passages that are asked for


def test_rank_is_limited_before_the_shuffle(spark):
    plan = QUERIES["tfidf_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Cartesian" not in plan
