import os
import shutil
import subprocess
import sys

import pytest

from framelens.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def same_rows(a, b):
    """Equal as multisets, whatever the integer width; columns by name."""
    assert sorted(a.columns) == sorted(b.columns)
    made = []
    for df in (a[sorted(a.columns)], b[sorted(b.columns)]):
        df = df.astype({c: float for c in df.columns if str(df[c].dtype).lower().startswith(("int", "float"))}).astype(object)
        made.append(sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None))))
    return made[0] == made[1]


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    """Against its SQL in DuckDB, or that it runs."""
    import duckdb

    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        assert same_rows(got, con.execute(catalogue.ORACLES[name]).df())
    else:
        assert len(got)


def test_everything_else_works_without_the_llm_folder(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
