"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import queries as plans
from tests.conftest import DATA


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(plans.Q))
def test_query(spark, con, name):
    df = plans.Q[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in plans.SQL:
        assert rows
        return
    cur = con.execute(plans.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_entry_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpusloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
