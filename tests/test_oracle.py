"""Every query of the library against its SQL, over the smallest tables, and whether results depend on partitions."""

import collections
import math
import os

import duckdb
import numpy as np
import pytest

from scanloom import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("nan", "NaT", "<NA>"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return round(float(v), 5) + 0.0 if isinstance(v, (float, np.floating)) else v


def rows(frame, columns):
    return collections.Counter(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_what_sql_gives(spark, con, name):
    out = catalogue.queries()[name](spark, DATA)
    found, wanted = out.toPandas(), con.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(out.columns) == sorted(wanted.columns)
    assert rows(found, sorted(out.columns)) == rows(wanted, sorted(out.columns))
    assert len(found)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("n", [1, 17])
@pytest.mark.parametrize("name", ["average_neighbour_dot_product", "dictionary_indexing_ncc", "remove_static_background_divide"])
def test_results_dont_depend_on_partitions(spark, name, n):
    query = catalogue.queries()[name]
    wanted = sorted(map(tuple, query(spark, DATA).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        assert sorted(map(tuple, query(spark, DATA).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
