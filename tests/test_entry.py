"""The driver's contract, and what is left of it without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerleaf.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, want))


def test_works_without_the_subpackage(tmp_path):
    for part in ("__spark_entry__.py", "ledgerleaf"):
        source = ROOT / part
        for f in [source] if source.is_file() else source.rglob("*.py"):
            if "llm" not in f.relative_to(ROOT).parts:
                to = tmp_path / f.relative_to(ROOT)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_text(f.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
