"""Every query that has SQL gives the same rows as the SQL; the entry runs; the corpus operators are optional."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from motifmill.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order))) for r in data)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql()[name]
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_corpus_operators(tmp_path):
    """The entry module works where the optional subpackage is gone, and fails loudly where it is broken."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("motifmill", "__spark_entry__.py"):
        os.system(f"cp -r {repo}/{name} {tmp_path}/")  # noqa: S605
    os.system(f"rm -rf {tmp_path}/motifmill/llm")  # noqa: S605
    code = "import __spark_entry__ as e; assert 'count_matches' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
