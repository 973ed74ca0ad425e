"""Every query against its SQL on the smallest tables, where they are there; and the entry without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sheafline.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(DATA))
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    a = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    b = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in want.fetchall())
    assert a == b


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_bundles_grow_with_the_tables(spark):
    assert catalog.queries()["bundle_decisions"](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_entry_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "sheafline", tmp_path / "sheafline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'income_check' in q and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_composition_is_dealt_to_all_tasks(spark, tmp_path):
    """The table's one file is one task as it is read."""
    spark.createDataFrame([(i, f"text {i} é") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.composed_docs(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
