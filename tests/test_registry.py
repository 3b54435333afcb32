"""Registered queries against their SQL on the smallest tables, and the optional subpackage."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from gleanery.plans import catalog, live, more, oracle

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def cells(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda x: None if pd.isna(x) else round(float(x), 5) + 0.0 if not isinstance(x, str) else x
    return Counter(tuple(map(one, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.SQL | live.SQL | more.SQL))
def test_query_is_its_sql(spark, db, name):
    got = (catalog.QUERIES | live.QUERIES | more.QUERIES)[name](spark, SMALL).toPandas()
    want = db.execute((oracle.SQL | live.SQL | more.SQL)[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES | live.QUERIES | more.QUERIES) - set(oracle.SQL | live.SQL | more.SQL)))
def test_other_queries_run(spark, name):
    assert (catalog.QUERIES | live.QUERIES | more.QUERIES)[name](spark, SMALL).count() > 0


def test_library_does_not_need_the_optional_subpackage():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['gleanery.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})
    for path in (root / "gleanery").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gleanery.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
