"""Every query with SQL against DuckDB, at the smallest scale."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
FOUND, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
#: Few rows suffice to see that a query runs; the rest is compared by the driver at a larger scale.
NAMES = sorted(n for n in SQL if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    plain = lambda x: None if x is None or x is pd.NaT or x is pd.NA or x != x else getattr(x, "item", lambda: x)()
    return sorted(repr([float(y) if isinstance(y := plain(x), (int, float)) and not isinstance(y, bool) else y for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = FOUND[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(FOUND)


def test_entry_imports_without_the_text_folders(tmp_path):
    """The registry also works where the optional folder and the pipeline are gone."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    copy.mkdir()
    (copy / "__spark_entry__.py").write_text(open(f"{here}/__spark_entry__.py").read())
    (copy / "tidewell").mkdir()
    for name in os.listdir(f"{here}/tidewell"):
        if name != "llm":
            os.symlink(f"{here}/tidewell/{name}", copy / "tidewell" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'historical_sma' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
