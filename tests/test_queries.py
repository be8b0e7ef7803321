"""Every registered query against its SQL twin on the smallest tables: names, types, rows."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from corvane import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
#: Where queries without SQL are held against a plain restatement.
BRUTE = {
    "j11_f18_minhash_pairs": "test_traps.py::test_minhash_pairs_against_exact_jaccard",
    "j18_greedy_removal": "test_near.py::test_removals_equal_the_sequential_pass",
    "j18_two_rules": "test_near.py::test_counters_of_rules",
    "j18_rule_counters": "test_near.py::test_counters_of_rules",
    "x01_scorer": "test_traps.py::test_scorer_failures_become_nulls",
    "x02_embedder": "test_queries.py::test_stand_in_vectors",
}
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        file, _, test = BRUTE[name].partition("::")
        assert f"def {test}(" in (Path(__file__).parent / file).read_text()
        return
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    kinds = {x[0]: str(x[1]) for x in got.description}
    assert not [(c, k, kinds[c]) for c, k in df.dtypes if KINDS.get(k, kinds[c]) != kinds[c]]
    assert rows == sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in got.fetchall()), key=repr)


def test_stand_in_vectors(spark):
    rows = registry.queries()["x02_embedder"](spark, DATA).collect()
    assert len({tuple(r["embedding"]) for r in rows}) > 1 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in rows)


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "corpus_hygiene_report" in e.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = registry.queries()
    for name in ("p08_j03_ngram_overlap", "j11_exact_jaccard", "f21_sparse_top", "j04_o02_remaining_with_limit"):
        assert "CartesianProduct" not in plan(q[name](spark, DATA)) and "BroadcastNestedLoopJoin" not in plan(q[name](spark, DATA))
    assert "WindowGroupLimit" in plan(q["j14_w01_nearest"](spark, DATA))
    assert "PushedFilters: [IsNotNull(grade" not in plan(q["p12_grade_filter"](spark, DATA))
    scan = plan(q["o03_longest"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in scan and "TakeOrderedAndProject" in scan
