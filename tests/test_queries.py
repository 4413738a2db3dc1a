"""Every registered query with reference SQL gives the rows that DuckDB gives, at the smallest size."""

import decimal
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from slotframe.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
#: Types that a value hash would tell apart.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(v) for v in r) for r in df.select(*columns).collect()])
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    kinds = {x[0]: str(x[1]) for x in result.description}
    for column, kind in df.dtypes:
        assert TYPES.get(kind) == kinds[column], column
    want = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kind", "n", "first_lower", "last_upper", "bytes"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["slotframe/llm"], ["corpus_pipeline.py"], ["slotframe/llm", "corpus_pipeline.py"]])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    """A copy of the tree without them still registers all other queries."""
    root = Path(__file__).resolve().parents[1]
    ignore = shutil.ignore_patterns("__pycache__", ".git", "tests")
    shutil.copytree(root, tmp_path / "tree", ignore=ignore)
    for name in gone:
        at = tmp_path / "tree" / name
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, 'op3_exact_dedup' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, check=True).stdout.split()
    assert int(out[0]) >= len(QUERIES) and int(out[1]) >= len(ORACLE_SQL) and out[2] == "False"
    if "slotframe/llm" in gone:
        assert out[3] == "False" and int(out[0]) == len(QUERIES)


def test_true_crc64_covers_long_urls(spark, tmp_path):
    from slotframe.functions.codecs import crc64_all

    urls = ["http://a.org/", "http://a.org/" + "x" * 4066, "http://a.org/" + "x" * 4074, "http://a.org/" + "x" * 4075, "y" * 5000 + "1", "y" * 5000 + "2", "é" * 3000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [r["crc64"] for r in QUERIES["true_crc64"](spark, str(tmp_path)).orderBy("page_id").collect()]
    want = []
    for u in urls:
        data, size = f"{u}|".encode(), 4096
        while size < len(data) + 8:
            size *= 2
        want.append(f"{int(crc64_all([data.ljust(size - 8, b'0')])[0]):016x}")
    assert got == want and len(set(got)) == len(urls)
