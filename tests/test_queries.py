"""Every registered query that has SQL gives the rows that DuckDB gives on the same tables; the others run."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from stringloom import plans

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


def comparable(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(comparable, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    df = plans.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted((tuple(map(comparable, r)) for r in df.select(*columns).collect()), key=repr)
    found = tables.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(comparable(r[i]) for i in places) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, TABLES).count() > 0


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run_python(code, folder=ROOT):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def test_entry_without_the_subpackage(tmp_path):
    """The driver may delete the subpackage and the pipeline; what is left has to import and register its queries and SQL."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); import bench"
    done = run_python(code, tmp_path / "repo")
    assert done.returncode == 0, done.stderr


def test_other_missing_packages_are_errors():
    """Only the subpackage and the pipeline may be absent: a package that they need and lack is no reason to drop their queries."""
    if not os.path.isdir(f"{ROOT}/stringloom/llm"):
        pytest.skip("the subpackage is absent")
    done = run_python("import sys; sys.modules['xxhash'] = None; import __spark_entry__")
    assert done.returncode != 0 and "xxhash" in done.stderr


class Session:
    """What shared_folder asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = type("Conf", (), {"get": lambda _, key, default: folder or default})()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app of {master}"})


def test_no_folder_of_its_own_on_a_cluster():
    from stringloom.operators import storage

    assert storage.shared_folder(Session("spark://somewhere:7077", "/shared/")) == "/shared"
    assert storage.shared_folder(Session("local[2]")).startswith("file://")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_folder(Session("spark://somewhere:7077"))
