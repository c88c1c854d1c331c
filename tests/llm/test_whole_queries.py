"""Every registered query of the subpackage on empty tables, and with extra columns whose names clash."""

from pathlib import Path

import pytest

from palimpsest.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = ["entity", "observation", "documents", "name_alias", "context_window", "lang_code"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    if not DATA.exists():
        pytest.skip("no test data here")
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    if not DATA.exists():
        pytest.skip("no test data here")
    folder = tmp_path_factory.mktemp("clash")
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        for extra in {"key", "count", "rank", "score", "cid", "uid", "vec", "parts", "form"} - set(df.columns):
            df = df.selectExpr("*", f"'x' AS {extra}")
        df.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found", "p6_ids"])
def test_query_with_clashing_columns(spark, clashing, name):
    assert QUERIES[name](spark, clashing).count() == QUERIES[name](spark, str(DATA)).count()
