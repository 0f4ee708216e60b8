"""Every query against its SQL on the smallest tables, and entry points that work without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioscope import plans

ROOT, DATA = Path(__file__).resolve().parent.parent, Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(row[k]) for k in order) for row in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    result = duck.execute(plans.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


@needs_data
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, str(DATA)).count() > 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """The library and its entry points are copied without it."""
    script = f"""
import shutil, sys
shutil.copytree({str(ROOT / 'folioscope')!r}, {str(tmp_path / 'folioscope')!r}, ignore=shutil.ignore_patterns('llm', '__pycache__'))
shutil.copy({str(ROOT / '__spark_entry__.py')!r}, {str(tmp_path)!r})
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith('op') or n == 'pipeline' for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "folioscope").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p


def test_names_come_from_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "a" + " " * 400 + "b"), (2, "x" * 400)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.nombre for r in plans.QUERIES["SNK-10"](spark, str(tmp_path)).collect()} == {1: "a_b", 2: "x" * 120}


def test_failures_are_read_in_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(5, "x" * 50 + " timeout"), (11, "x" * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.razon for r in plans.QUERIES["CLS-19"](spark, str(tmp_path)).collect()} == {5: "timeout", 11: "error_inesperado"}
