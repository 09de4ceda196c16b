"""Queries over tables whose map has an incomplete last row, or points without a pattern."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom import catalogue
from scanloom.scan import Scan
from scanloom.sources import load, save

#: By query, the points of 60 that the table doesn't have. The last of three map rows has 10 of 25 points.
ABSENT = {
    "edax_up1_file": (7, 25),
    "h5_file": (7, 25),
    "edax_up2_file": (7, 25),
    "nordif_file": (7, 25),
    "oxford_ebsp_file": (),
    "h5_file_bruker": (7, 25),
    "h5_file_edax": (7, 25),
    "h5_file_oxford": (7, 25),
    "h5_file_simulated": (7, 25),
}


@pytest.mark.parametrize("name", ABSENT)
def test_a_file_of_an_incomplete_map_gives_what_sql_gives(spark, tmp_path, name):
    path, absent = str(tmp_path / "embeddings.parquet"), ABSENT[name]
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.sin(F.col("id") * 1.7 + k * (F.col("id") % 7 + 1)).cast("float"))
    spark.range(60).filter(~F.col("id").isin(*absent) if absent else F.lit(True)).select(F.col("id").alias("vec_id"), pixels.alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(path)
    out = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    wanted = con.execute(catalogue.oracle_sql()[name]).fetchdf()
    columns = sorted(wanted.columns)
    assert sorted(out.columns) == columns and len(wanted) == 64 * (60 - len(absent))
    frames = [f[columns].astype(float).round(5).sort_values(columns).to_numpy() for f in (out, wanted)]
    np.testing.assert_array_equal(*frames)


@pytest.mark.parametrize("suffix", ["up1", "up2", "dat", "h5"])
def test_patterns_are_written_at_their_places(spark, tmp_path, suffix):
    places = [1, 2, 4, 5, 8]
    df = spark.createDataFrame([(10 * k, k // 4, k % 4, [k, k + 1]) for k in places], "idx bigint, y int, x int, pixels array<int>")
    path = str(tmp_path / f"a.{suffix}")
    save(Scan(df, (1, 2), "uint16" if suffix == "up2" else "uint8", (3, 4)), path)
    options = {"up1": {"ny": 3, "nx": 4}, "dat": {"ny": 3, "nx": 4, "rows": 1, "cols": 2}}.get(suffix, {})
    found = [r["pixels"] for r in load(spark, path, **options).df.orderBy("idx").collect()]
    assert found == [[k, k + 1] if k in places else [0, 0] for k in range(12)]
    twice = df.union(df.limit(1))
    with pytest.raises(Exception, match="several patterns at one place"):
        save(Scan(twice, (1, 2), "uint8", (3, 4)), path, overwrite=True)
    with pytest.raises(ValueError, match="outside"):
        save(Scan(df, (1, 2), "uint8", (2, 4)), path, overwrite=True)
