"""Rotations, detectors, calibration, master patterns, simulation, refinement, crystal maps."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.kernels import geometry as kg
from scanloom.kernels import optimise
from scanloom.operators import calibration, crystal_maps, decomposition, refinement, simulation
from scanloom.operators.detector import Detector
from scanloom.operators.master_pattern import MasterPattern, euler_grid
from scanloom.plans import geometry_queries as gq


def test_gnomonic_bounds_and_scale():
    d = Detector((480, 640), pc=[0.4210, 0.7794, 0.5049])
    np.testing.assert_allclose(d.gnomonic_bounds[0], [-1.111771, 1.529016, -0.436918, 1.543672], atol=1e-5)
    np.testing.assert_allclose([d.x_scale[0], d.y_scale[0]], [0.004133, 0.004135], atol=1e-6)


def test_sample_to_detector():
    q = Detector(sample_tilt=70).sample_to_detector_quaternion
    np.testing.assert_allclose(q, [0.6964, -0.1228, -0.1228, -0.6964], atol=1e-4)


@pytest.mark.parametrize(
    ("shape", "pc", "convention", "wanted", "options"),
    [
        ((60, 80), (0.25, 0, 0.75), "oxford", (0.25, 1, 1), {}),
        ((60, 80), (0.6, 0.6, 0.6), "tsl", (0.6, 0.4, 0.6), {}),
        ((480, 480), (0, 0, 15000), "emsoft", (0.5, 0.5, 0.625), {"px_size": 50}),
    ],
)
def test_conventions(shape, pc, convention, wanted, options):
    d = Detector(shape, pc=pc, convention=convention, **options)
    np.testing.assert_allclose(d.pc[0], wanted, atol=1e-9)
    np.testing.assert_allclose(d.pc_in(convention)[0], pc, atol=1e-9)
    with pytest.raises(ValueError, match="convention"):
        d.pc_in("nothing")


def test_coordinates_round_trip_and_crop():
    d = Detector((48, 60), pc=np.random.default_rng(0).uniform(0.3, 0.7, (2, 3, 3)))
    at = np.array([[3.0, 5.0], [40.0, 50.0]])
    np.testing.assert_allclose(d.to_pixel_coords(d.to_gnomonic_coords(at, (1, 2)), (1, 2)), at)
    assert d.to_gnomonic_coords(at).shape == (2, 3, 2, 2)
    cut = d.crop(4, 100, 6, 50)
    assert cut.shape == (44, 44) and cut.navigation_shape == (2, 3)
    np.testing.assert_allclose(cut.pcx, (d.pcx * 60 - 6) / 44)
    assert (d.r_max() >= d.r_max(compat=True)).all()
    with pytest.raises(ValueError, match="extent"):
        d.crop(5, 5, 0, 1)


def test_rotations():
    q = np.random.default_rng(1).normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    back = kg.quaternion_from_euler(kg.euler_from_quaternion(q))
    assert kg.misorientation_angle(q, back).max() < 1e-6
    v = np.random.default_rng(2).normal(size=3)
    np.testing.assert_allclose(kg.matrix(kg.product(q[0], q[1])) @ v, kg.matrix(q[0]) @ (kg.matrix(q[1]) @ v), atol=1e-12)
    assert kg.misorientation_angle(kg.quaternion_from_matrix(kg.matrix(q[3])), q[3]) < 1e-6


def test_lambert_round_trip():
    v = np.random.default_rng(3).normal(size=(500, 3))
    v = np.abs(v / np.linalg.norm(v, axis=1, keepdims=True)) * np.array([1, -1, 1])
    np.testing.assert_allclose(kg.lambert_to_vector(kg.vector_to_lambert(v) / np.sqrt(np.pi / 2)), v, atol=1e-7)
    np.testing.assert_allclose(kg.stereographic_to_vector(*kg.vector_to_stereographic(v).T), v, atol=1e-12)


def test_projective_fit_gives_a_plane_back():
    at = np.stack(np.meshgrid(np.arange(5), np.arange(6), indexing="ij")).astype(float)
    pc = np.stack([0.4 + at[1] / 200, 0.7 - at[0] / 300, 0.5 + at[0] / 500], axis=-1)
    for kind in ("projective", "affine"):
        fit, over, tilt = calibration.fit_pc(pc, at, at, kind)
        np.testing.assert_allclose(fit, pc.reshape(-1, 3), atol=1e-6)
        np.testing.assert_allclose(over, pc, atol=1e-6)
        assert tilt == pytest.approx(np.rad2deg(np.pi / 2 + np.arctan(-500 / 300)), abs=1e-6)
    assert np.rad2deg(calibration.estimate_xtilt_ztilt(pc)[0]) == pytest.approx(abs(np.rad2deg(np.arctan2(1 / 500, 1 / 300))), abs=1e-6)
    with pytest.raises(ValueError, match="transformation"):
        calibration.fit_pc(pc, at, at, "other")


def test_robust_tilt_leaves_outliers_out():
    z = np.linspace(0.4, 0.6, 50)
    pc = np.column_stack([z * 0, 0.9 - 0.5 * z, z])
    pc[[3, 30], 1] += 0.4
    tilt, outlier = calibration.estimate_xtilt_robust(pc, residual=1e-3)
    assert np.flatnonzero(outlier).tolist() == [3, 30] and tilt == pytest.approx(np.pi / 2 + np.arctan(-0.5))


def test_affine_fit_in_spark(spark):
    df = spark.createDataFrame([(r, c, 0.4 + c / 200, 0.7 - r / 300, 0.5 + r / 500 + c / 900) for r in range(5) for c in range(4)], "y int, x int, pcx double, pcy double, pcz double")
    out = calibration.apply_pc_fit(df.select("y", "x", F.col("pcx").alias("was")), calibration.fit_pc_affine(df)).collect()
    assert max(abs(r["pcx"] - r["was"]) for r in out) < 1e-12


def test_moving_screen(spark):
    found = calibration.moving_screen(calibration.points_table(spark, gq._IN, gq._OUT), (480, 480), 5).collect()
    assert 0 < len(found) <= 10 and all(0 < r["pcx"] < 1 for r in found)


def test_minimisers():
    rosen = lambda rows, x: (1 - x[:, 0]) ** 2 + 100 * (x[:, 1] - x[:, 0] ** 2) ** 2
    x, value, count = optimise.nelder_mead(rosen, np.array([[-1.2, 1.0], [2.0, 2.0]]), np.array([0.5, 0.5]), xtol=1e-8, ftol=1e-8)
    np.testing.assert_allclose(x, 1, atol=1e-5)
    assert (count > 3).all() and (value < 1e-8).all()
    low, high = np.full((2, 2), -3.0), np.full((2, 2), 3.0)
    x, *_ = optimise.nelder_mead(lambda r, x: ((x - 5) ** 2).sum(1), np.zeros((2, 2)), np.ones(2), low, high)
    np.testing.assert_allclose(x, 3, atol=1e-3)
    x, *_ = optimise.differential_evolution(rosen, low, high, max_iter=200, tol=1e-8)
    np.testing.assert_allclose(x, 1, atol=0.05)


@pytest.fixture(scope="module")
def seen(spark):
    return gq._simulated(spark, None)


def test_refined_orientations_are_the_true_ones(seen):
    patterns, moved = seen
    truth = {r["idx"]: np.array([r[c] for c in "abcd"]) for r in patterns.collect()}
    out = refinement.refine_orientation(patterns.withColumns(moved), gq._SCREEN, gq._BANDS, trust_region=(3, 3, 3), tol=1e-5).collect()
    angle = [np.rad2deg(kg.misorientation_angle(np.array([r[c] for c in "abcd"]), truth[r["idx"]])) for r in out]
    assert max(angle) < 0.8 and np.median(angle) < 0.01 and min(r["score"] for r in out) > 0.998


def test_refined_projection_centres_are_the_true_ones(seen):
    patterns, _ = seen
    out = refinement.refine_projection_center(patterns, gq._SCREEN.with_pc([0.46, 0.71, 0.56]), gq._BANDS, tol=1e-6).collect()
    np.testing.assert_allclose([[r["pcx"], r["pcy"], r["pcz"]] for r in out], np.tile([0.45, 0.72, 0.55], (16, 1)), atol=2e-3)


def test_pseudo_symmetry_finds_the_operation(seen):
    patterns, _ = seen
    op = np.array([np.cos(np.pi / 6), 0, 0, np.sin(np.pi / 6)])
    inverse = op * [1, -1, -1, -1]
    wrong = kg.product(np.broadcast_to(inverse, (16, 4)), gq._some_rotations())
    spark = patterns.sparkSession
    start = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(wrong)], "idx bigint, a double, b double, c double, d double")
    out = refinement.refine_orientation(patterns.select("idx", "pixels").join(start, "idx"), gq._SCREEN, gq._BANDS, trust_region=(1, 1, 1), pseudo_symmetry_ops=np.array([op])).collect()
    assert sum(r["pseudo_symmetry_index"] == 1 for r in out) >= 15


def test_refinement_of_nothing_and_of_nulls(seen):
    patterns, _ = seen
    assert refinement.refine_orientation(patterns.filter("idx < 0"), gq._SCREEN, gq._BANDS).count() == 0
    broken = patterns.withColumn("pixels", F.when(F.col("idx") > 1, F.col("pixels"))).withColumn("a", F.when(F.col("idx") != 3, F.col("a")))
    out = {r["idx"]: r["score"] for r in refinement.refine_orientation(broken, gq._SCREEN, gq._BANDS, max_iter=3).collect()}
    assert {k for k, v in out.items() if v is None} == {0, 1, 3}
    with pytest.raises(ValueError, match="method"):
        refinement.refine_orientation(patterns, gq._SCREEN, gq._BANDS, method="guess")


def test_master_patterns(spark):
    m = MasterPattern(np.random.default_rng(0).random((2, 21, 21)), energies=(10.0, 20.0))
    assert m.hemisphere == "upper" and m.as_lambert().projection == "lambert" and m.at_energy(11).shape == (2, 21, 21)
    with pytest.raises(ValueError, match="Lambert"):
        m.for_projection()
    with pytest.raises(ValueError, match="both hemispheres"):
        MasterPattern(np.ones((5, 5)), projection="lambert", centrosymmetric=False).for_projection()
    assert m.rescale_intensity((0, 1)).upper.max() == 1 and abs(m.normalize_intensity().upper.mean()) < 1e-12
    own = euler_grid(spark, 90).limit(3).withColumns({"pcx": F.lit(0.5), "pcy": F.lit(0.5), "pcz": F.lit(0.5)})
    one = m.as_lambert().get_patterns(own.drop("pcx", "pcy", "pcz"), Detector((4, 5))).collect()
    each = m.as_lambert().get_patterns(own, Detector((4, 5))).collect()
    np.testing.assert_allclose([r["pixels"] for r in one], [r["pixels"] for r in each])


def test_zone_axes_are_distinct_and_reduced():
    axes = simulation.zone_axes_of(np.array([[1, 0, 0], [0, 2, 0], [0, 0, 1]]))
    assert sorted(map(tuple, np.abs(axes))) == [(0, 0, 1), (0, 0, 1), (0, 1, 0), (0, 1, 0), (1, 0, 0), (1, 0, 0)]
    direct, reciprocal = simulation.reciprocal_basis((3, 4, 5, 80, 95, 110))
    np.testing.assert_allclose(direct @ reciprocal.T, np.eye(3), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(direct, axis=1), [3, 4, 5])
    with pytest.raises(ValueError, match="Bragg"):
        simulation.kinematical_master(None, simulation.Reflectors(np.eye(3)), 5)


def test_phases():
    a, b = crystal_maps.Phase("ni", 225, (3.5, 3.5, 3.5, 90, 90, 90)), crystal_maps.Phase("ni", 229, (2.9, 2.9, 2.9, 90, 90, 90))
    assert crystal_maps.different_in(a, b) == ["space_group", "lattice"] and not crystal_maps.different_in(a, a)
    kept, new = crystal_maps.merge_phases([a, b, a])
    assert new == {0: 0, 1: 1, 2: 0} and kept[1].name == "ni1"


def test_merging_takes_the_best_of_each_point(spark):
    schema = "idx bigint, phase_id int, scores array<double>, simulation_indices array<bigint>"
    one = spark.createDataFrame([(0, 0, [0.9, 0.2], [0, 1]), (1, 0, [0.5, 0.4], [2, 3]), (2, -1, [0.1, 0.1], [0, 0]), (3, 0, [0.3, 0.3], [1, 1])], schema)
    two = spark.createDataFrame([(0, 0, [0.8, 0.7], [0, 1]), (1, 0, [0.6, 0.1], [2, 3]), (2, -1, [0.2, 0.1], [0, 0])], schema)
    out = {r["idx"]: r for r in crystal_maps.merge_crystal_maps([one, two]).collect()}
    assert [out[k]["phase_id"] for k in range(4)] == [0, 1, -1, 0]
    assert out[0]["merged_scores"] == [0.9, 0.8, 0.7, 0.2] and out[0]["merged_simulation_indices"] == [0, 4, 5, 1]
    assert {r["idx"]: r["phase_id"] for r in crystal_maps.merge_crystal_maps([one, two], mean_n_best=2).collect()}[0] == 1
    assert crystal_maps.merge_crystal_maps([one, two], greater_is_better=False).filter("idx = 0").first()["phase_id"] == 1


def test_decomposition(spark):
    x = np.random.default_rng(0).normal(size=(40, 3)) @ np.random.default_rng(1).normal(size=(3, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "idx bigint, pixels array<double>").repartition(5)
    found, size = decomposition.factors(df, 12, 5)
    assert (size[:3] > 1e-6).all() and (size[3:] < 1e-6).all()
    for c in (3, [0, 1, 2]):
        out = np.array([r["pixels"] for r in decomposition.decomposition_model(df, 12, c).orderBy("idx").collect()])
        np.testing.assert_allclose(out, x, atol=1e-8)
    assert len(decomposition.loadings(df, found).first()["loadings"]) == 5


@pytest.mark.parametrize("method", ["basinhopping", "dual_annealing", "shgo", "differential_evolution", "ln_neldermead"])
def test_methods_of_refinement(method):
    q = gq._some_rotations()[:6]
    master, cosines = gq._BANDS.for_projection(None), kg.direction_cosines(gq._SCREEN.shape, gq._SCREEN.pc_flattened[0], gq._SCREEN.sample_to_detector)
    turn = np.array([np.cos(0.007), np.sin(0.007), 0, 0])
    start = kg.product(q, np.broadcast_to(turn, q.shape))
    start = np.where(start[:, :1] < 0, -start, start)
    pc = np.repeat(gq._SCREEN.pc_flattened, 6, axis=0)
    out = refinement.refine_block(kg.project(master, q, cosines), start, pc, ["orientation"], master, gq._SCREEN.shape, gq._SCREEN.sample_to_detector, method=method, trust_region=(3, 3, 3))
    angle = np.degrees(2 * np.arccos(np.clip(np.abs((q * out["q"]).sum(axis=1)), 0, 1)))
    assert angle.max() < 0.8 and out["score"].min() > 0.99 and (out["num_evals"] > 0).all()


def test_a_homography_of_many_points_takes_little_memory():
    h = np.array([[1.1, 0.02, 3.0], [-0.05, 0.9, -2.0], [1e-4, -2e-4, 1.0]])
    for n in (4, 5, 4000):
        src = np.random.default_rng(n).uniform(0, 60, (n, 2))
        dst = np.column_stack([src, np.ones(n)]) @ h.T
        tracemalloc.start()
        found = calibration.homography(src, dst[:, :2] / dst[:, 2:])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        np.testing.assert_allclose(found, h, atol=1e-8)
        assert peak < 16 << 20


def test_projective_fits_of_an_incomplete_map_are_exact():
    idx = np.arange(411 * 25 - 19)
    y, x = idx // 25, idx % 25
    pc = np.column_stack([0.4 + x / 1000, 0.7 - y / 500, 0.5 + y / 800 + x / 9000])
    at = np.stack([y, x])
    fit, whole, tilt = calibration.fit_pc(pc, at, at[:, :, None], "projective")
    np.testing.assert_allclose(fit, pc, atol=1e-11)
    np.testing.assert_allclose(whole[:, 0], pc, atol=1e-11)
    assert tilt == pytest.approx(np.rad2deg(np.pi / 2 + np.arctan(np.polyfit(pc[:, 2], pc[:, 1], 1)[0])), abs=1e-9)


@pytest.mark.parametrize("kinds", [["orientation"], ["orientation", "pc"]])
def test_orientations_near_a_pole_of_their_angles_are_refined(kinds):
    """Where Phi is near 0 or 180 degrees a small turn changes the other two angles by far more than the trust region."""
    euler = np.deg2rad([[63, 177.6, 61], [121, 178.0, 267], [305, 177.4, 273], [62, 1.8, 264], [356, 1.0, 86], [251, 2.7, 260], [33, 179.5, 291], [100, 0.0, 20], [100, 13.0, 20], [40, 168.0, 300]])
    truth = kg.quaternion_from_euler(euler)
    half = np.deg2rad(0.4)
    started = kg.product(truth, np.array([np.cos(half), np.sin(half), 0, 0]))
    master, screen = gq._BANDS.for_projection(), gq._SCREEN
    pc = np.tile(screen.pc_flattened, (len(truth), 1))
    seen = kg.project(master, truth, kg.direction_cosines(screen.shape, pc, screen.sample_to_detector))
    trust = (3, 3, 3, 0.05, 0.05, 0.05)[: 3 * len(kinds)]
    out = refinement.refine_block(seen, started, pc, kinds, master, screen.shape, screen.sample_to_detector, trust_region=trust)
    assert np.rad2deg(kg.misorientation_angle(out["q"], truth)).max() < 0.2


@pytest.mark.parametrize("kept", [None, np.arange(48) % 5 != 0])
def test_patterns_are_projected_from_projection_centres_as_along_cosines(kept):
    rng, turn = np.random.default_rng(8), kg.sample_to_detector(70, 5, 2, 1)
    q, pc, master = rng.normal(size=(40, 4)), rng.uniform(0.3, 0.8, (40, 3)), rng.normal(size=(2, 31, 31))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    v = kg.direction_cosines((6, 8), pc, turn, kept)
    xy = kg.vector_to_lambert(v @ np.swapaxes(kg.matrix(q), -1, -2)) / np.sqrt(np.pi / 2) * 15 + 15
    up = (v @ np.swapaxes(kg.matrix(q), -1, -2))[..., 2] >= 0
    i, j = np.floor(xy[..., 1]).astype(int).clip(0, 29), np.floor(xy[..., 0]).astype(int).clip(0, 29)
    f, g, half = xy[..., 1] - i, xy[..., 0] - j, np.where(up, 0, 1)
    wanted = (1 - f) * (1 - g) * master[half, i, j] + (1 - f) * g * master[half, i, j + 1] + f * (1 - g) * master[half, i + 1, j] + f * g * master[half, i + 1, j + 1]
    np.testing.assert_allclose(kg.project_from(master, q, (6, 8), pc, turn, kept), wanted, atol=1e-9)
    np.testing.assert_allclose(kg.project(master, q, v), wanted, atol=1e-9)


def test_refinement_is_dealt_out_evenly(spark, tmp_path):
    """A table in one file is refined by several tasks, with as many rows in each."""
    spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit(0).alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, _ = gq._simulated(spark, str(tmp_path))
    rows = [r["count"] for r in seen.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 600 and len(rows) > 1 and max(rows) - min(rows) <= len(rows)
