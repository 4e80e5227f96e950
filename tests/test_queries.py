"""Every query of the core against its SQL, and its plan against collections that grow."""

import pytest

from siftline.plans import registry
from tests.conftest import DATA, same_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck):
    ours, theirs = same_rows(QUERIES[name](spark, DATA), duck, SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_no", "coverage", "fused", "pos"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filter_is_pushed_down(spark):
    plan = QUERIES["star_join"](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_workers_need_no_path_of_the_driver(tmp_path):
    import pathlib
    import subprocess
    import sys

    root = str(pathlib.Path(__file__).parents[1])
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from siftline.runtime import session; print(e.queries()['dictionary_counts'](session('2'), {DATA!r}).count())"
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 0, done.stderr[-2000:]
