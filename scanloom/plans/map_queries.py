"""Queries of neighbourhoods, of dictionary indexing and of crystal maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom import streaming
from scanloom.functions.windows import Window
from scanloom.operators import crystal_maps, indexing, neighbours
from scanloom.plans.projections import P_SHAPE, dictionary, experimental, long, patterns, r6
from scanloom.plans.registry import CENTRED, P, PX, R, UNIT, query
from scanloom.storage import scratch_path

_CROSS = "o(dy, dx) AS (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))"


@query(f"WITH {P}, {CENTRED}, {_CROSS}, m AS (SELECT a.idx, avg(list_dot_product(a.q, b.q)) AS adp FROM un a, o JOIN un b ON b.y = a.y + dy AND b.x = a.x + dx WHERE dy <> 0 OR dx <> 0 GROUP BY a.idx) SELECT idx, {R('adp')} AS adp FROM un LEFT JOIN m USING (idx)")
def average_neighbour_dot_product(spark, d):
    return neighbours.average_neighbour_dot_product(patterns(spark, d), P_SHAPE).select("idx", r6("adp").alias("adp"))


@query(f"WITH {P}, {CENTRED}, {_CROSS} SELECT a.idx, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, {R('list_dot_product(a.q, b.q)')} AS dp FROM un a, o JOIN un b ON b.y = a.y + dy AND b.x = a.x + dx")
def neighbour_dot_products(spark, d):
    out = neighbours.neighbour_dot_products(patterns(spark, d), P_SHAPE, tile=8)
    each = out.select("idx", F.posexplode("dot_products").alias("k", "dp")).filter("dp is not null")
    return each.select("idx", (F.floor(F.col("k") / 3) - 1).cast("int").alias("dy"), (F.col("k") % 3 - 1).cast("int").alias("dx"), r6("dp").alias("dp"))


_RESCALED = f"m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM e WINDOW w AS (PARTITION BY idx)) SELECT idx, pixel, {R('CASE WHEN hi <> lo THEN (v - lo) / (hi - lo) * 255.0 END')} AS v FROM m"


@query(f"WITH {P}, {PX}, {_CROSS}, e AS (SELECT a.idx, b.pixel, avg(b.v) AS v FROM p a, o JOIN px b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL), {_RESCALED}")
def average_neighbour_patterns(spark, d):
    return long(neighbours.average_neighbour_patterns(patterns(spark, d), P_SHAPE, out_range=(0, 255)), "idx")


@query(f"WITH {P}, {PX}, o AS (SELECT a.i - 1 AS dy, b.i - 2 AS dx, exp(-0.5 * (pow(a.i - 1, 2) + pow(b.i - 2, 2))) AS w FROM range(3) a(i), range(5) b(i)), e AS (SELECT a.idx, b.pixel, sum(w * b.v) / sum(w) AS v FROM p a, o JOIN px b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL), {_RESCALED}")
def average_neighbour_patterns_gaussian(spark, d):
    return long(neighbours.average_neighbour_patterns(patterns(spark, d), P_SHAPE, Window("gaussian", (3, 5), {"std": 1}), out_range=(0, 255), tile=8), "idx")


def _best(vectors: str, k: int, where: str = "true", e: str = "e.idx % 4 = 0", among: str = "d.idx % 4 <> 0") -> str:
    """CTE best: idx, rank, sim_idx, score."""
    return f"s AS (SELECT e.idx, d.idx AS sim_idx, list_dot_product(e.q, d.q) AS score FROM {vectors} e, {vectors} d WHERE {e} AND {among} AND {where}), best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, sim_idx) AS INTEGER) AS rank FROM s) WHERE rank <= {k})"


_RANKED = f"SELECT idx, rank, sim_idx, {R('score')} AS score FROM best"


def _matches(df: DataFrame) -> DataFrame:
    return indexing.ranked_matches(df, "idx").select("idx", "rank", "sim_idx", r6("score").alias("score"))


@query(f"WITH {P}, {CENTRED}, {_best('un', 5)} {_RANKED}")
def dictionary_indexing_ncc(spark, d):
    return _matches(indexing.dictionary_indexing(experimental(spark, d), dictionary(spark, d), 64, "ncc", 5))


@query(f"WITH {P}, {UNIT}, {_best('uq', 5)} {_RANKED}")
def dictionary_indexing_ndp(spark, d):
    return _matches(indexing.dictionary_indexing(experimental(spark, d), dictionary(spark, d), 64, "ndp", 5))


@query(f"WITH p0 AS (SELECT vec_id AS idx, 0 AS y, 0 AS x, label AS phase, CAST(embedding AS DOUBLE[]) AS p FROM embeddings), p AS (SELECT idx, y, x, phase, list(p[i + 1] ORDER BY i) AS p FROM p0, range(64) t(i) WHERE sqrt(pow(i // 8 - 4, 2) + pow(i % 8 - 4, 2)) <= 4 GROUP BY ALL), {CENTRED}, {_best('un', 3)} {_RANKED}")
def dictionary_indexing_signal_mask(spark, d):
    mask = Window("circular", P_SHAPE).values == 0
    return _matches(indexing.dictionary_indexing(experimental(spark, d), dictionary(spark, d), 64, "ncc", 3, signal_mask=mask))


@query(f"WITH {P}, {CENTRED}, {_best('un', 3, 'e.idx % 8 <> 0')} {_RANKED}")
def dictionary_indexing_navigation_mask(spark, d):
    return _matches(indexing.dictionary_indexing(experimental(spark, d), dictionary(spark, d), 64, "ncc", 3, navigation_mask=F.col("idx") % 8 == 0))


@query(f"WITH {P}, {CENTRED}, {_best('un', 5)} {_RANKED}")
def dictionary_indexing_from_files(spark, d):
    """As for a dictionary that is too large to be sent to the tasks."""
    return _matches(indexing.dictionary_indexing(experimental(spark, d), dictionary(spark, d), 64, "ncc", 5, broadcast_bytes=0))


@query()
def dictionary_indexing_whole_scan(spark, d):
    """All vectors against all vectors; the queries with SQL index a quarter of them against the others."""
    df = patterns(spark, d)
    return _matches(indexing.dictionary_indexing(df, df.select(F.col("idx").alias("sim_idx"), "phase_id", "pixels"), 64, "ncc", 5))


@query(f"WITH {P}, {CENTRED}, {_best('un', 5)} {_RANKED}")
def streaming_dictionary_indexing(spark, d):
    """The experimental patterns come as a stream."""
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/embeddings.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/embeddings.parquet*")
    points = stream.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("pixels"))
    found = streaming.index_stream(points, dictionary(spark, d), 64, "ncc", 5)
    path = scratch_path(spark, "stream")
    streaming.write_patterns(found, path, f"{path}-state", available_now=True).awaitTermination()
    return _matches(spark.read.schema("idx bigint, scores array<double>, simulation_indices array<bigint>").parquet(path))


@query(f"""WITH {P}, {CENTRED}, {_best('un', 5)}, t AS (SELECT idx, (idx // 4) // 25 AS y, (idx // 4) % 25 AS x, list(sim_idx) AS a FROM best GROUP BY idx), o(dy, dx) AS (VALUES (-1, 0), (0, -1), (0, 1), (1, 0)),
m AS (SELECT a.idx, avg(len(list_intersect(a.a, b.a))) / 5 AS osm FROM t a, o JOIN t b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.idx) SELECT idx, {R('osm')} AS osm FROM t LEFT JOIN m USING (idx)""")
def orientation_similarity_map(spark, d):
    xmap = indexing.dictionary_indexing(experimental(spark, d), dictionary(spark, d), 64, "ncc", 5)
    return neighbours.orientation_similarity_map(xmap, 5, normalize=True).select("idx", r6("osm").alias("osm"))


def _two_maps(spark, d):
    e = experimental(spark, d).drop("phase_id")
    maps = [indexing.dictionary_indexing(e, dictionary(spark, d).filter(F.col("phase_id") % 2 == k), 64, "ncc", 3) for k in (0, 1)]
    return [m.withColumn("phase_id", F.when((F.col("idx") % 20 == 0), -1).otherwise(0)) for m in maps]


def _merged_sql(mean: int) -> str:
    return f"""WITH {P}, {CENTRED}, {_best('un', 3, among='d.idx % 4 <> 0 AND d.phase % 2 = 0').replace('best AS', 'b0 AS').replace('s AS (', 's0 AS (', 1).replace('FROM s)', 'FROM s0)')},
{_best('un', 3, among='d.idx % 4 <> 0 AND d.phase % 2 = 1').replace('best AS', 'b1 AS').replace('s AS (', 's1 AS (', 1).replace('FROM s)', 'FROM s1)')},
every AS (SELECT 0 AS k, * FROM b0 UNION ALL SELECT 1 AS k, * FROM b1),
lift AS (SELECT abs((SELECT max(sim_idx) FROM b0) - (SELECT min(sim_idx) FROM b1)) + 1 AS n),
mean AS (SELECT idx, k, avg(score) AS m FROM every WHERE rank <= {mean} GROUP BY ALL),
won AS (SELECT idx, CASE WHEN max(CASE WHEN k = 0 THEN m END) >= max(CASE WHEN k = 1 THEN m END) THEN 0 ELSE 1 END AS k FROM mean GROUP BY idx),
ranked AS (SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, rank, k) AS INTEGER) AS n, score, sim_idx + k * lift.n AS sim_idx FROM every, lift)
SELECT idx, CAST(CASE WHEN idx % 20 = 0 THEN -1 ELSE w.k END AS INTEGER) AS phase_id, n, {R('r.score')} AS merged_score, r.sim_idx AS merged_index, e.sim_idx AS best_index FROM won w JOIN ranked r USING (idx) JOIN every e USING (idx) WHERE e.k = w.k AND e.rank = 1"""


def _merged(spark, d, mean):
    out = crystal_maps.merge_crystal_maps(_two_maps(spark, d), mean)
    both = F.arrays_zip(F.col("merged_scores").alias("s"), F.col("merged_simulation_indices").alias("i"))
    each = out.select("idx", "phase_id", F.get("simulation_indices", F.lit(0)).alias("best_index"), F.posexplode(both).alias("n", "m"))
    return each.select("idx", "phase_id", (F.col("n") + 1).alias("n"), r6("m.s").alias("merged_score"), F.col("m.i").alias("merged_index"), "best_index")


@query(_merged_sql(1))
def merge_crystal_maps(spark, d):
    return _merged(spark, d, 1)


@query(_merged_sql(3))
def merge_crystal_maps_mean_of_best(spark, d):
    return _merged(spark, d, 3)


@query(f"WITH {P} SELECT idx, CAST(CASE WHEN phase < 2 THEN -1 ELSE phase END AS INTEGER) AS phase_id, {R('CASE WHEN phase < 2 THEN 1.0 ELSE p[1] END')} AS a, {R('CASE WHEN phase < 2 THEN 0.0 ELSE p[2] END')} AS b FROM p")
def map_from_index_data(spark, d):
    data = patterns(spark, d).select("idx", F.when(F.col("phase_id") < 2, -1).otherwise(F.col("phase_id")).alias("phase"), F.slice("pixels", 1, 4).alias("quat"))
    first = F.get("rotations", F.lit(0))
    return crystal_maps.map_from_index_data(data).select("idx", "phase_id", r6(first["a"]).alias("a"), r6(first["b"]).alias("b"))
