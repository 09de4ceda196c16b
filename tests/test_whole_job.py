"""Queries over tables that are larger than the smallest ones: no row of the table may be left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom import catalogue


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """1010 vectors, 41 rows of 25, the last one with 10."""
    path = tmp_path_factory.mktemp("tall")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.sin(F.col("id") * 1.7 + k * (F.col("id") % 7 + 1)).cast("float"))
    spark.range(1010).select(F.col("id").alias("vec_id"), pixels.alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_fill_missing_fills_the_map_of_its_table(spark, tall):
    out = catalogue.queries()["fill_missing"](spark, tall).groupBy("y", "x").agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("most")).collect()
    assert {(r["y"], r["x"]) for r in out} == {(y, x) for y in range(41) for x in range(25)} and {r["n"] for r in out} == {64}
    absent = {(r["y"], r["x"]) for r in out if r["most"] == 0}
    assert absent == {(k // 25, k % 25) for k in range(41 * 25) if k % 3 == 0 or k >= 1010}


def test_extract_grid_spans_the_map_of_its_table(spark, tall):
    out = catalogue.queries()["extract_grid"](spark, tall).collect()
    assert sorted({r["y"] for r in out}) == [7, 16, 25, 34] and sorted({r["x"] for r in out}) == [5, 10, 15, 20] and len(out) == 16


@pytest.mark.parametrize("name", ["refine_orientation", "refine_projection_center", "refine_orientation_projection_center"])
def test_refinement_refines_a_pattern_for_each_row_of_the_table(spark, tall, name):
    out = catalogue.queries()[name](spark, tall).collect()
    assert sorted(r["idx"] for r in out) == list(range(1010))
    scores = sorted(r["score"] for r in out)
    assert scores[len(scores) // 2] > 0.99 and scores[0] > 0.5


def test_indexing_of_a_whole_scan_finds_the_best_of_all_pairs(spark, tall):
    out = catalogue.queries()["dictionary_indexing_whole_scan"](spark, tall).collect()
    p = np.array([r["embedding"] for r in spark.read.parquet(f"{tall}/embeddings.parquet").orderBy("vec_id").collect()], float)
    p -= p.mean(axis=1, keepdims=True)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    wanted = -np.sort(-(p @ p.T), axis=1)[:, :5]
    found = np.full((1010, 5), np.nan)
    for r in out:
        found[r["idx"], r["rank"] - 1] = r["score"]
        assert abs(p[r["idx"]] @ p[r["sim_idx"]] - r["score"]) < 1e-5
    assert len(out) == 5050
    np.testing.assert_allclose(found, wanted, atol=1e-5)
