"""Single patterns, neighbourhoods and indexing of a 3 x 3 map of 3 x 3 patterns, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions.windows import Window, distance_to_origin, lowpass_fft_filter, modified_hann
from scanloom.kernels import images
from scanloom.operators import frequency, indexing, intensity, neighbours, selection
from scanloom.operators.virtual_imaging import VirtualImager
from scanloom.scan import Scan

PATTERNS = [
    [5, 6, 5, 7, 6, 5, 6, 1, 0], [9, 7, 8, 7, 0, 8, 8, 7, 6], [0, 3, 3, 5, 2, 9, 3, 3, 9], [8, 1, 7, 6, 4, 8, 8, 2, 2], [4, 0, 9, 0, 1, 0, 2, 2, 5],
    [8, 6, 0, 4, 7, 7, 7, 6, 0], [4, 1, 6, 3, 4, 0, 1, 1, 0], [5, 9, 8, 4, 6, 0, 2, 9, 2], [9, 4, 3, 6, 5, 6, 2, 5, 9],
]
BACKGROUND = [5, 4, 5, 4, 3, 4, 4, 4, 3]
SHAPE = (3, 3)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, k // 3, k % 3, p) for k, p in enumerate(PATTERNS)], "idx bigint, y int, x int, pixels array<smallint>").cache()


@pytest.fixture(scope="module")
def scan(df):
    return Scan(df, SHAPE, "uint8", (3, 3), static_background=np.array(BACKGROUND))


def pixels(out, idx=0):
    return out.filter(F.col("idx") == idx).first()["pixels"]


@pytest.mark.parametrize(
    ("options", "wanted"),
    [
        ({"dtype_out": "uint8"}, [182, 218, 182, 255, 218, 182, 218, 36, 0]),
        ({"dtype_out": "uint8", "out_range": (0, 100)}, [71, 85, 71, 100, 85, 71, 85, 14, 0]),
        ({"dtype_out": "uint8", "relative": True}, [141, 170, 141, 198, 170, 141, 170, 28, 0]),
    ],
)
def test_rescale(df, options, wanted):
    assert pixels(intensity.rescale_intensity(df, **options)) == wanted


def test_rescale_to_floats_and_percentiles(df):
    np.testing.assert_allclose(pixels(intensity.rescale_intensity(df, dtype_out="float32")), [0.4285, 0.7142, 0.4285, 1, 0.7142, 0.4285, 0.7142, -0.7142, -1], atol=1e-4)
    np.testing.assert_allclose(pixels(intensity.rescale_intensity(df, dtype_out="uint8", percentiles=(10, 90))), [198, 245, 198, 254, 245, 198, 245, 9, 0], atol=2)
    with pytest.raises(ValueError, match="exclude"):
        intensity.rescale_intensity(df, relative=True, percentiles=(1, 99))


def test_static_background(scan):
    assert pixels(scan.remove_static_background().df) == [127, 212, 127, 255, 255, 170, 212, 0, 0]
    with pytest.raises(ValueError, match="operation"):
        scan.remove_static_background("add")


@pytest.mark.parametrize(
    ("options", "wanted"),
    [
        ({"filter_domain": "spatial", "std": 2}, [170, 215, 181, 255, 221, 188, 221, 32, 0]),
        ({"filter_domain": "frequency", "std": 1, "truncate": 3}, [111, 191, 141, 255, 253, 243, 221, 0, 38]),
    ],
)
def test_dynamic_background(scan, options, wanted):
    np.testing.assert_allclose(pixels(scan.remove_dynamic_background(**options).df), wanted, atol=1)


def test_image_quality(scan):
    iq = lambda n: [r["iq"] for r in scan.get_image_quality(n).orderBy("idx").collect()]
    np.testing.assert_allclose(iq(True), [-0.0241, -0.0625, -0.0052, -0.0317, -0.0458, -0.0956, -0.1253, 0.0120, -0.2385], atol=1e-4)
    np.testing.assert_allclose(iq(False), [0.2694, 0.2926, 0.2299, 0.2673, 0.1283, 0.2032, 0.1105, 0.2671, 0.2159], atol=1e-4)


def test_image_quality_of_noise_and_of_a_flat_image():
    noise = np.random.default_rng(0).random((1, 200, 200))
    assert abs(images.image_quality(noise)[0]) < 1e-2
    assert images.image_quality(np.ones((1, 60, 60)), normalize=False)[0] == pytest.approx(1, abs=1e-2)


@pytest.mark.parametrize("tile", [1, 2, 32])
def test_neighbour_average(df, tile):
    out = neighbours.average_neighbour_patterns(df, SHAPE, dtype_out="uint8", tile=tile)
    assert out.count() == 9
    assert pixels(out) == [255, 109, 218, 218, 36, 236, 255, 36, 0]
    assert pixels(out, 1) == [143, 111, 255, 159, 0, 207, 159, 63, 175]


def test_orientation_similarity_of_equal_lists(spark):
    xmap = spark.createDataFrame([(k, k // 10, k % 10, [1, 2, 3, 4, 5]) for k in range(100)], "idx bigint, y int, x int, simulation_indices array<bigint>")
    assert {r["osm"] for r in neighbours.orientation_similarity_map(xmap, tile=4).collect()} == {5.0}
    assert {r["osm"] for r in neighbours.orientation_similarity_map(xmap, normalize=True).collect()} == {1.0}
    alone = xmap.filter("idx = 0")
    assert neighbours.orientation_similarity_map(alone).first()["osm"] is None
    assert neighbours.orientation_similarity_map(xmap, from_n_best=3).first()["osm"] == [5.0, 4.0, 3.0]


@pytest.mark.parametrize("metric", ["ncc", "ndp"])
def test_a_scan_finds_itself(df, metric):
    found = indexing.dictionary_indexing(df, df.select(F.col("idx").alias("sim_idx"), "pixels"), 9, metric, 2)
    for r in found.collect():
        assert r["simulation_indices"][0] == r["idx"] and r["scores"][0] == pytest.approx(1)


def test_ties_go_to_the_smaller_index(spark, df):
    copies = spark.createDataFrame([(k, PATTERNS[0]) for k in (9, 4, 7, 2)], "sim_idx bigint, pixels array<smallint>")
    for limit in (0, 1 << 20):
        found = indexing.dictionary_indexing(df, copies, 9, "ndp", 3, broadcast_bytes=limit).filter("idx = 0").first()
        assert found["simulation_indices"] == [2, 4, 7]


def test_a_metric_of_ones_own_and_rotations(spark, df):
    class Distance(indexing.SimilarityMetric):
        def match(self, e, d):
            return ((e[:, None] - d[None]) ** 2).sum(-1)

    dictionary = df.select(F.col("idx").alias("sim_idx"), "pixels")
    rotations = spark.createDataFrame([(k, 1.0, 0.0, 0.0, float(k)) for k in range(9)], "sim_idx bigint, a double, b double, c double, d double")
    found = indexing.dictionary_indexing(df, dictionary, 9, Distance(sign=-1), 1, rotations=rotations)
    assert all(r["scores"] == [0.0] and r["rotation"]["d"] == r["idx"] for r in found.collect())
    with pytest.raises(ValueError, match="metric"):
        indexing.dictionary_indexing(df, dictionary, 9, "cosine")
    with pytest.raises(ValueError, match="float32 or float64"):
        indexing.NormalizedDotProduct(dtype="int8")


def test_null_constant_and_short_patterns_give_null(spark):
    odd = spark.createDataFrame([(0, 0, 0, None), (1, 0, 1, [2] * 9), (2, 0, 2, [1, 2]), (3, 1, 0, PATTERNS[0])], "idx bigint, y int, x int, pixels array<smallint>")
    outs = [
        intensity.rescale_intensity(odd.filter("idx <> 2")), intensity.normalize_intensity(odd.filter("idx <> 2")), intensity.remove_dynamic_background(odd, SHAPE, std=1),
        frequency.fft_filter(odd, SHAPE, np.ones(SHAPE), rescale_to=(0, 1)), neighbours.average_neighbour_patterns(odd, SHAPE, Window("circular", (1, 1))),
    ]
    for out in outs:
        got = {r["idx"]: r["pixels"] for r in out.collect()}
        assert all(got[k] is None for k in got if k < 3) and got[3] is not None
    assert {r["idx"] for r in frequency.image_quality(odd, SHAPE).filter("iq is null").collect()} == {0, 1, 2}
    found = indexing.dictionary_indexing(odd, odd.select(F.col("idx").alias("sim_idx"), "pixels"), 9, keep_n=5)
    assert {r["idx"]: r["simulation_indices"] for r in found.collect()} == {0: None, 1: None, 2: None, 3: [3]}


def test_empty_tables(df):
    none = df.filter("idx < 0")
    assert intensity.remove_dynamic_background(none, SHAPE).count() == 0
    assert neighbours.average_neighbour_dot_product(none, SHAPE).count() == 0
    assert indexing.dictionary_indexing(none, df.select(F.col("idx").alias("sim_idx"), "pixels"), 9).count() == 0
    assert intensity.rescale_intensity(none, relative=True).count() == 0


def test_maps_are_kept_apart(df):
    two = df.withColumn("scan_id", F.lit("a")).unionByName(df.withColumn("scan_id", F.lit("b")))
    out = neighbours.average_neighbour_patterns(two, SHAPE, dtype_out="uint8", maps=["scan_id"], tile=2)
    assert out.count() == 18 and out.filter("idx = 1").select("pixels").distinct().count() == 1


def test_scan_follows_selections(scan):
    small = scan.crop(1, 3, 0, 2)
    assert small.map_shape() == (2, 2) and sorted(r["idx"] for r in small.df.collect()) == [3, 4, 6, 7]
    cut = scan.crop_signal(1, 3, 0, 3)
    assert cut.shape == (2, 3) and np.ravel(cut.static_background).tolist() == BACKGROUND[3:]
    assert pixels(cut.df) == PATTERNS[0][3:]
    assert scan.inav(slice(0, 3, 2), 1).df.count() == 2
    assert scan.rebin((3, 3)).df.first()["pixels"][0] == sum(p[0] for p in PATTERNS)
    assert scan.map(lambda b: b[:, ::-1], None).df.filter("idx = 0").first()["pixels"][:3] == [6, 1, 0]
    assert scan.add_poissonian_noise(3).df.collect() == scan.add_poissonian_noise(3).df.collect()


def test_grid_indices():
    assert [a.tolist() for a in selection.grid_indices((2, 2), (9, 9))] == [[3, 6], [3, 6]]
    axes, spacing = selection.grid_indices((4, 5), (55, 75), return_spacing=True)
    assert [a.tolist() for a in axes] == [[11, 22, 33, 44], [12, 25, 38, 51, 64]] and spacing == (11, 13)
    assert selection.grid_indices(10, 105)[0].tolist() == [8, 18, 28, 38, 48, 58, 68, 78, 88, 98]


def test_windows():
    assert images.frequency_weights((3, 3)).tolist() == [[1, 4, 1], [4, 7, 4], [1, 4, 1]]
    assert distance_to_origin((5, 5))[0, 0] == pytest.approx(2.8284, abs=1e-4)
    np.testing.assert_allclose(modified_hann(11)[:5], [0.1423, 0.4154, 0.6548, 0.8412, 0.9594], atol=1e-4)
    assert modified_hann(96).sum() == pytest.approx(61.1182, abs=1e-4)
    np.testing.assert_allclose(lowpass_fft_filter((5, 5), 1, 1)[0], [0.0012, 0.0470, 0.1353, 0.0470, 0.0012], atol=1e-4)
    g = Window("gaussian", (3, 3), {"std": 0.5}).values
    np.testing.assert_allclose((g / g.sum())[1, :2], [0.08381951, 0.61934703], atol=1e-7)
    assert Window("circular", (3, 3)).values.sum() == 5 and Window("circular", (3, 3)).n_neighbours == (1, 1)
    with pytest.raises(ValueError, match="unknown window"):
        Window("oval")


def test_correlation_is_centred():
    image = np.random.default_rng(1).random((1, 7, 9))
    window = np.random.default_rng(2).random((3, 4))
    padded = np.pad(image[0], [(1, 1), (2, 1)], mode="edge")
    wanted = [[(padded[r : r + 3, c : c + 4] * window).sum() for c in range(9)] for r in range(7)]
    np.testing.assert_allclose(images.correlate(image, window)[0], wanted)


def test_equalisation_flattens_a_histogram():
    out = images.clahe(np.random.default_rng(3).random((2, 64, 64)) ** 4)
    assert 0 <= out.min() and out.max() <= 1 and abs(np.median(out) - 0.5) < 0.05


def test_virtual_imager_regions():
    imager = VirtualImager((10, 12))
    assert imager.grid_shape == (5, 5) and imager.region((0, 0)) == (0, 2, 0, 2) and imager.region([(1, 1), (2, 3)]) == (2, 6, 2, 9)
    with pytest.raises(ValueError, match="grid"):
        VirtualImager((3, 3), (4, 1))


def test_repeated_map_points_are_refused(spark):
    rows = [(k, k // 3, k % 3, [float(v) for v in np.random.default_rng(k).random(9)]) for k in range(9)]
    schema = "idx bigint, y int, x int, pixels array<double>"
    fine = spark.createDataFrame(rows + [(10, None, 1, rows[0][3])], schema)
    assert neighbours.average_neighbour_dot_product(fine, (3, 3)).count() == 9
    with pytest.raises(Exception, match="several rows are at y=1, x=1"):
        neighbours.average_neighbour_dot_product(spark.createDataFrame(rows + [(9, 1, 1, rows[0][3])], schema), (3, 3)).collect()
