"""The entry module, and the queries against their SQL."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tribune import queries

ROOT = Path(__file__).resolve().parent.parent


def same(spark, name, run, sql, sf_dir):
    got = run(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    names = sorted(got.columns)

    def rows(df):
        plain = lambda x: "" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)
        return sorted(tuple(plain(x) for x in r) for r in df[names].astype(object).itertuples(index=False)) if len(df) else []

    assert rows(got) == rows(want), name


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["speech_id", "count"] and df.count() > 0


def run_copy(tmp_path, code):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "tribune", "tests", "__spark_entry__.py"):
            (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "tribune").mkdir()
    for name in os.listdir(ROOT / "tribune"):
        if name != "llm":
            (tmp_path / "tribune" / name).symlink_to(ROOT / "tribune" / name)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


WITHOUT = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 30 and not e.llm and not e.pipeline"


def test_works_without_the_llm_folders(tmp_path):
    run_copy(tmp_path, WITHOUT)


def test_works_without_what_the_llm_folders_import(tmp_path):
    # a pipeline whose package is gone, as if one of its dependencies were not installed
    (tmp_path / "corpus_pipeline.py").write_text("from tribune.llm import absent")
    run_copy(tmp_path, "import sys; sys.modules['ahocorasick'] = None\n" + WITHOUT)
