"""Queries of single patterns, of the frequency domain, of selections and of virtual images."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from scanloom.functions import pixels as px
from scanloom.functions.windows import Window, distance_to_origin, highpass_fft_filter, lowpass_fft_filter, modified_hann
from scanloom.kernels import images
from scanloom.operators import decomposition, frequency, intensity, selection
from scanloom.operators.virtual_imaging import VirtualImager, virtual_image
from scanloom.plans.projections import L_SHAPE, P_SHAPE, activity, long, patterns, quantities, r6
from scanloom.plans.registry import P, PX, E, L, R, query

MINMAX = "min(v) OVER w AS lo, max(v) OVER w AS hi"
OVER = "WINDOW w AS (PARTITION BY idx)"


def scaled(a: float, b: float, v: str = "v") -> str:
    return R(f"CASE WHEN hi <> lo THEN ({v} - lo) / (hi - lo) * {float(b - a)} + {float(a)} END")


@query(f"WITH {P}, {PX}, m AS (SELECT *, {MINMAX} FROM px {OVER}) SELECT idx, pixel, {scaled(-1, 1)} AS v FROM m")
def rescale_intensity(spark, d):
    return long(intensity.rescale_intensity(patterns(spark, d)), "idx")


@query(f"WITH {L}, m AS (SELECT *, {MINMAX} FROM lx {OVER}) SELECT idx, pixel, CAST(floor(CASE WHEN hi <> lo THEN (v - lo) / (hi - lo) * 255.0 END) AS SMALLINT) AS v FROM m")
def rescale_intensity_uint8(spark, d):
    df = intensity.rescale_intensity(quantities(spark, d), dtype_out="uint8")
    return df.select("idx", F.posexplode("pixels").alias("pixel", "v"))


@query(f"WITH {L}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM lx) SELECT idx, pixel, {scaled(0, 255)} AS v FROM lx, m")
def rescale_intensity_relative(spark, d):
    return long(intensity.rescale_intensity(quantities(spark, d), relative=True, out_range=(0, 255)), "idx")


@query(f"WITH {P}, {PX}, m AS (SELECT idx, pixel, greatest(least(v, 0.1), -0.1) AS v, -0.1 AS lo, 0.1 AS hi FROM px) SELECT idx, pixel, {scaled(0, 100)} AS v FROM m")
def rescale_intensity_in_range(spark, d):
    return long(intensity.rescale_intensity(patterns(spark, d), in_range=(-0.1, 0.1), out_range=(0, 100)), "idx")


@query(f"WITH {P}, {PX}, q AS (SELECT idx, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM px GROUP BY idx), m AS (SELECT idx, pixel, greatest(least(v, hi), lo) AS v, lo, hi FROM px JOIN q USING (idx)) SELECT idx, pixel, {scaled(0, 255)} AS v FROM m")
def rescale_intensity_percentiles(spark, d):
    return long(intensity.rescale_intensity(patterns(spark, d), percentiles=(10, 90), out_range=(0, 255)), "idx")


@query(f"WITH {E}, m AS (SELECT *, {MINMAX} FROM ex {OVER}) SELECT idx, pixel, {scaled(0, 1)} AS v FROM m")
def rescale_intensity_activity(spark, d):
    return long(intensity.rescale_intensity(activity(spark, d), out_range=(0, 1)), "idx")


@query(f"WITH {P}, {PX} SELECT idx, pixel, {R('(v - avg(v) OVER w) / stddev_pop(v) OVER w')} AS v FROM px {OVER}")
def normalize_intensity(spark, d):
    return long(intensity.normalize_intensity(patterns(spark, d)), "idx")


@query(f"WITH {L} SELECT idx, pixel, {R('(v - avg(v) OVER w) / (2.0 * stddev_pop(v) OVER w * sqrt(49.0))')} AS v FROM lx {OVER}")
def normalize_intensity_square_root(spark, d):
    return long(intensity.normalize_intensity(quantities(spark, d), num_std=2, divide_by_square_root=True), "idx")


def _static(source: str, operation: str, scale: bool, out: str) -> str:
    b = "(b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) * (max(v) OVER w - min(v) OVER w) + min(v) OVER w" if scale else "b"
    value = "v - b" if operation == "subtract" else "CASE WHEN b <> 0 THEN v / b END"
    return f"""WITH {source}, bg AS (SELECT pixel, avg(v) AS b FROM {out} GROUP BY pixel), j AS (SELECT idx, pixel, v, b FROM {out} JOIN bg USING (pixel)),
s AS (SELECT idx, pixel, v, {b} AS b FROM j {OVER}), e AS (SELECT idx, pixel, {value} AS v FROM s), m AS (SELECT *, {MINMAX} FROM e {OVER})
SELECT idx, pixel, {scaled(0, 255)} AS v FROM m"""


@query(_static(f"{P}, {PX}", "subtract", False, "px"))
def remove_static_background(spark, d):
    return long(intensity.remove_static_background(patterns(spark, d), out_range=(0, 255)), "idx")


@query(_static(L, "divide", False, "lx"))
def remove_static_background_divide(spark, d):
    return long(intensity.remove_static_background(quantities(spark, d), operation="divide", out_range=(0, 255)), "idx")


@query(_static(L, "subtract", True, "lx"))
def remove_static_background_scaled(spark, d):
    return long(intensity.remove_static_background(quantities(spark, d), scale_bg=True, out_range=(0, 255)), "idx")


@query(f"WITH {L} SELECT CAST(pixel AS INTEGER) AS pixel, {R('avg(v)')} AS v FROM lx GROUP BY pixel")
def mean_pattern(spark, d):
    return long(intensity.mean_pattern(quantities(spark, d)), column="background")


@query(f"WITH {P}, {PX} SELECT idx, {R('avg(v)')} AS mean, {R('sum(v)')} AS sum FROM px GROUP BY idx")
def pixel_reductions(spark, d):
    p = F.col("pixels")
    return patterns(spark, d).select("idx", r6(px.mean(p)).alias("mean"), r6(px.total(p)).alias("sum"))


_FREQUENCY = "k AS (SELECT i AS m, exp(-0.5 * pow(i - 1.5, 2)) / sum(exp(-0.5 * pow(i - 1.5, 2))) OVER () AS w FROM range(4) t(i)), a AS (SELECT n.i AS n, least(greatest(n.i + m - 2, 0), 7) AS s, w FROM range(8) n(i), k)"
_SPATIAL = "k AS (SELECT i AS m, exp(-0.5 * pow(i - 4, 2)) / sum(exp(-0.5 * pow(i - 4, 2))) OVER () AS w FROM range(9) t(i)), a0 AS (SELECT n.i AS n, (n.i + m - 4 + 16) % 16 AS s, w FROM range(8) n(i), k), a AS (SELECT n, CASE WHEN s < 8 THEN s ELSE 15 - s END AS s, w FROM a0)"
_BLUR = "bl AS (SELECT idx, CAST(ar.n * 8 + ac.n AS INTEGER) AS pixel, sum(ar.w * ac.w * v) AS b FROM px JOIN a ar ON ar.s = r JOIN a ac ON ac.s = c GROUP BY ALL)"


def _dynamic(weights: str, value: str) -> str:
    return f"WITH {P}, {PX}, {weights}, {_BLUR}, e AS (SELECT idx, pixel, {value} AS v FROM px JOIN bl USING (idx, pixel)), m AS (SELECT *, {MINMAX} FROM e {OVER}) SELECT idx, pixel, {scaled(0, 255)} AS v FROM m"


@query(_dynamic(_FREQUENCY, "v - b"))
def remove_dynamic_background(spark, d):
    return long(intensity.remove_dynamic_background(patterns(spark, d), P_SHAPE, out_range=(0, 255)), "idx")


@query(_dynamic(_SPATIAL, "v - b"))
def remove_dynamic_background_spatial(spark, d):
    return long(intensity.remove_dynamic_background(patterns(spark, d), P_SHAPE, filter_domain="spatial", out_range=(0, 255)), "idx")


@query(f"WITH {P}, {PX}, {_FREQUENCY}, {_BLUR} SELECT idx, pixel, {R('b')} AS v FROM bl")
def dynamic_background(spark, d):
    return long(intensity.dynamic_background(patterns(spark, d), P_SHAPE), "idx")


@query(f"WITH {P}, {PX}, e AS (SELECT idx, CAST(r // 2 * 4 + c // 2 AS INTEGER) AS pixel, sum(v) AS v FROM px GROUP BY ALL), m AS (SELECT *, {MINMAX} FROM e {OVER}) SELECT idx, pixel, {scaled(0, 255)} AS v FROM m")
def downsample(spark, d):
    return long(intensity.downsample(patterns(spark, d), P_SHAPE, 2, out_range=(0, 255)), "idx")


@query(f"WITH {P}, {PX} SELECT idx, pixel, {R('v + c * 0.5 + r * -0.25 + 2.0')} AS v FROM px")
def add_ramp(spark, d):
    return long(intensity.add_ramp(patterns(spark, d), P_SHAPE, 0.5, -0.25, 2.0), "idx")


@query(f"WITH {L} SELECT idx, pixel, CAST(v AS INTEGER) AS v FROM lx")
def change_dtype(spark, d):
    df = intensity.change_dtype(quantities(spark, d), "uint16")
    return df.select("idx", F.posexplode("pixels").alias("pixel", "v"))


@query()
def adaptive_histogram_equalization(spark, d):
    return long(intensity.adaptive_histogram_equalization(patterns(spark, d), P_SHAPE), "idx")


@query()
def add_gaussian_noise(spark, d):
    return long(intensity.add_noise(patterns(spark, d), P_SHAPE, std=0.1, seed=7), "idx")


# Frequency domain

_BASIS = "f AS (SELECT u.i AS u, w.i AS w, n.r AS r, n.c AS c, cos(2 * pi() * (u.i * n.r + w.i * n.c) / 8.0) AS co, sin(2 * pi() * (u.i * n.r + w.i * n.c) / 8.0) AS si FROM range(8) u(i), range(8) w(i), (SELECT a.i AS r, b.i AS c FROM range(8) a(i), range(8) b(i)) n)"
_AMPLITUDE = "s AS (SELECT idx, u, w, sqrt(pow(sum(v * co), 2) + pow(sum(v * si), 2)) AS a FROM z JOIN f USING (r, c) GROUP BY idx, u, w)"
_WEIGHT = "k AS (SELECT i, CASE WHEN i < 4 THEN i + 1 ELSE i - 8 END AS n FROM range(8) t(i)), wt AS (SELECT a.i AS u, b.i AS w, a.n * a.n + b.n * b.n - 1.0 AS t FROM k a, k b)"
_QUALITY = f"{_AMPLITUDE}, {_WEIGHT} SELECT idx, {R('1 - sum(a * t) / sum(a) / (SELECT avg(t) FROM wt)')} AS iq FROM s JOIN wt USING (u, w) GROUP BY idx"


@query(f"WITH {P}, {PX}, z AS (SELECT idx, r, c, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM px {OVER}), {_BASIS}, {_QUALITY}")
def image_quality(spark, d):
    return frequency.image_quality(patterns(spark, d), P_SHAPE).select("idx", r6("iq").alias("iq"))


@query(f"WITH {P}, {PX}, z AS (SELECT idx, r, c, v FROM px), {_BASIS}, {_QUALITY}")
def image_quality_raw(spark, d):
    return frequency.image_quality(patterns(spark, d), P_SHAPE, normalize=False).select("idx", r6("iq").alias("iq"))


@query(f"WITH {P}, {PX}, z AS (SELECT idx, r, c, v FROM px), {_BASIS}, {_AMPLITUDE} SELECT idx, CAST(u * 8 + w AS INTEGER) AS pixel, {R('a')} AS v FROM s")
def fft_spectrum(spark, d):
    return long(frequency.fft_spectrum(patterns(spark, d), P_SHAPE), "idx", column="spectrum")


@query(f"WITH {P}, {PX}, {_BASIS} SELECT idx, CAST(u * 8 + w AS INTEGER) AS pixel, {R('sum(v * co)')} AS re, {R('-sum(v * si)')} AS im FROM px JOIN f USING (r, c) GROUP BY idx, u, w")
def fft(spark, d):
    both = frequency.fft(patterns(spark, d), P_SHAPE).select("idx", F.posexplode(F.arrays_zip("re", "im")).alias("pixel", "s"))
    return both.select("idx", "pixel", r6("s.re").alias("re"), r6("s.im").alias("im"))


@query(f"WITH {P}, {PX} SELECT idx, pixel, {R('v')} AS v FROM px")
def ifft(spark, d):
    return long(frequency.ifft(frequency.fft(patterns(spark, d), P_SHAPE, shift=True), P_SHAPE, shift=True), "idx")


def _filtered(h: str) -> str:
    return f"""WITH {P}, {PX}, {_BASIS}, s AS (SELECT idx, u, w, sum(v * co) AS a, sum(v * si) AS b FROM px JOIN f USING (r, c) GROUP BY idx, u, w),
h0 AS (SELECT a.i AS u, b.i AS w, sqrt(pow((a.i + 4) % 8 - 4, 2) + pow((b.i + 4) % 8 - 4, 2)) AS q FROM range(8) a(i), range(8) b(i)), h AS (SELECT u, w, {h} AS h FROM h0)
SELECT idx, CAST(f.r * 8 + f.c AS INTEGER) AS pixel, {R('sum(h * (a * co + b * si)) / 64')} AS v FROM s JOIN h USING (u, w) JOIN f USING (u, w) GROUP BY idx, f.r, f.c"""


@query(_filtered("CASE WHEN q < 2 THEN 1.0 WHEN q > 4 THEN 0.0 ELSE exp(-pow((q - 2) / (sqrt(2) / 2), 2)) END"))
def lowpass_fft(spark, d):
    return long(frequency.fft_filter(patterns(spark, d), P_SHAPE, Window("lowpass", P_SHAPE, {"cutoff": 2, "cutoff_width": 1}), shift=True), "idx")


@query(_filtered("CASE WHEN q > 2 THEN 1.0 WHEN q < 1 THEN 0.0 ELSE exp(-pow((2 - q) / (sqrt(2) * 0.5 / 2), 2)) END"))
def highpass_fft(spark, d):
    return long(frequency.fft_filter(patterns(spark, d), P_SHAPE, Window("highpass", P_SHAPE, {"cutoff": 2, "cutoff_width": 0.5}), shift=True), "idx")


@query(f"""WITH {P}, {PX}, k(dr, dc, w) AS (VALUES (-1, -1, 1.0), (-1, 0, 2.0), (-1, 1, 1.0), (0, -1, 2.0), (0, 0, 5.0), (0, 1, 3.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)),
e AS (SELECT o.idx, o.pixel, sum(w * n.v) AS v FROM px o, k JOIN px n ON n.idx = o.idx AND n.r = least(greatest(o.r + dr, 0), 7) AND n.c = least(greatest(o.c + dc, 0), 7) GROUP BY ALL) SELECT idx, pixel, {R('v')} AS v FROM e""")
def fft_filter_spatial(spark, d):
    return long(frequency.fft_filter(patterns(spark, d), P_SHAPE, np.array([[1, 2, 1], [2, 5, 3], [1, 2, 1.0]]), "spatial"), "idx")


def _grid(spark, values: np.ndarray):
    rows = [(r, c, float(v)) for (r, c), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "r int, c int, v double").select("r", "c", r6("v").alias("v"))


def _cells(rows: int, cols: int, v: str) -> str:
    return f"SELECT CAST(a.i AS INTEGER) AS r, CAST(b.i AS INTEGER) AS c, {R(v)} AS v FROM range({rows}) a(i), range({cols}) b(i)"


@query(_cells(5, 7, "sqrt(pow(a.i - 2, 2) + pow(b.i - 3, 2))"))
def window_distance(spark, d):
    return _grid(spark, distance_to_origin((5, 7)))


_Q = "sqrt(pow(a.i - 4, 2) + pow(b.i - 4, 2))"


@query(_cells(9, 9, f"CASE WHEN {_Q} < 3 THEN 1.0 WHEN {_Q} > 6 THEN 0.0 ELSE exp(-pow(({_Q} - 3) / (sqrt(2) * 1.5 / 2), 2)) END"))
def window_lowpass(spark, d):
    return _grid(spark, lowpass_fft_filter((9, 9), 3))


@query(_cells(9, 9, f"CASE WHEN {_Q} > 3 THEN 1.0 WHEN {_Q} < 1 THEN 0.0 ELSE exp(-pow((3 - {_Q}) / (sqrt(2) / 2), 2)) END"))
def window_highpass(spark, d):
    return _grid(spark, highpass_fft_filter((9, 9), 3, 1))


@query(_cells(1, 11, "cos(pi() * (b.i - 11 / 2.0 + 0.5) / 11)"))
def window_modified_hann(spark, d):
    return _grid(spark, modified_hann(11)[None])


@query(_cells(4, 5, "exp(-0.5 * (pow((a.i - 1.5) / 2, 2) + pow((b.i - 2) / 2.0, 2)))"))
def window_gaussian(spark, d):
    return _grid(spark, Window("gaussian", (4, 5), {"std": 2}).values)


@query(_cells(5, 5, "CASE WHEN sqrt(pow(a.i - 2, 2) + pow(b.i - 2, 2)) > 2 THEN 0.0 ELSE 1.0 END"))
def window_circular(spark, d):
    return _grid(spark, Window("circular", (5, 5)).values)


@query(_cells(4, 5, "pow(CASE WHEN a.i < 2 THEN a.i + 1 ELSE a.i - 4 END, 2) + pow(CASE WHEN b.i < 2 THEN b.i + 1 ELSE b.i - 5 END, 2) - 1"))
def fft_frequency_vectors(spark, d):
    return _grid(spark, images.frequency_weights((4, 5)))


# Selections

_AXES = "e AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM p), st AS (SELECT *, (ny + 4) // 5 AS sy, (nx + 5) // 6 AS sx FROM e), l AS (SELECT *, (ny - 1) // sy * sy AS ly, (nx - 1) // sx * sx AS lx FROM st), sh AS (SELECT *, CAST(floor((sy - ny + ly) / 2.0) AS INTEGER) AS dy, CAST(floor((sx - nx + lx) / 2.0) AS INTEGER) AS dx FROM l)"


@query(f"WITH {P}, {_AXES} SELECT idx, y, x FROM p, sh WHERE (y + dy) % sy = 0 AND y + dy BETWEEN sy AND ly AND (x + dx) % sx = 0 AND x + dx BETWEEN sx AND lx")
def extract_grid(spark, d):
    """A grid of 4 x 5 points in the middle of the map that the table spans."""
    df = patterns(spark, d)
    return selection.extract_grid(df, (4, 5), selection.map_shape(df)).select("idx", "y", "x")


@query(f"WITH {P}, {PX} SELECT idx, CAST(y - 3 AS INTEGER) AS y, CAST(x - 5 AS INTEGER) AS x, pixel, {R('v')} AS v FROM px WHERE y >= 3 AND y < 9 AND x >= 5 AND x < 17")
def crop_navigation(spark, d):
    return long(selection.crop_navigation(patterns(spark, d), 3, 9, 5, 17), "idx", "y", "x")


@query(f"WITH {P}, {PX} SELECT idx, CAST((r - 1) * 4 + c - 2 AS INTEGER) AS pixel, {R('v')} AS v FROM px WHERE r >= 1 AND r < 7 AND c >= 2 AND c < 6")
def crop_signal(spark, d):
    return long(selection.crop_signal(patterns(spark, d), P_SHAPE, 1, 7, 2, 6), "idx")


@query(f"WITH {P} SELECT idx, y, x FROM p WHERE y >= 2 AND y < 15 AND (y - 2) % 3 = 0 AND x = 4")
def slice_navigation(spark, d):
    return selection.slice_navigation(patterns(spark, d), slice(2, 15, 3), 4).select("idx", "y", "x")


@query(f"WITH {P}, {PX} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 5 AS INTEGER) AS x, pixel, {R('sum(v)')} AS v FROM px GROUP BY ALL")
def rebin_navigation(spark, d):
    return long(selection.rebin_navigation(patterns(spark, d), (2, 5)), "y", "x")


@query(f"WITH {P}, {PX} SELECT idx, CAST(r // 4 * 4 + c // 2 AS INTEGER) AS pixel, {R('sum(v)')} AS v FROM px GROUP BY idx, r // 4, c // 2")
def rebin_signal(spark, d):
    return long(selection.rebin_signal(patterns(spark, d), P_SHAPE, (4, 2)), "idx")


@query(f"WITH {P}, {PX}, k AS (SELECT idx, pixel, v FROM px WHERE sqrt(pow(r - 4, 2) + pow(c - 4, 2)) <= 4) SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY pixel) - 1 AS INTEGER) AS pixel, {R('v')} AS v FROM k")
def mask_patterns(spark, d):
    return long(selection.mask_patterns(patterns(spark, d), Window("circular", P_SHAPE).values == 0), "idx")


_RECTANGLE = "SELECT max(y) - min(y) + 1 AS ny, max(x) - min(x) + 1 AS nx, count(*) = (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AND count(*) = count(DISTINCT (y, x)) AS is_rectangular FROM s"


@query(f"WITH {P}, s AS (SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM p WHERE y BETWEEN 2 AND 9 AND x BETWEEN 1 AND 20) {_RECTANGLE}")
def roi_is_rectangular(spark, d):
    return selection.roi_is_rectangular(patterns(spark, d).filter("y between 2 and 9 and x between 1 and 20"), "y", "x")


@query(f"WITH {P}, s AS (SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM p WHERE phase < 5) {_RECTANGLE}")
def roi_is_not_rectangular(spark, d):
    return selection.roi_is_rectangular(patterns(spark, d).filter("phase_id < 5"), "y", "x")


@query(f"WITH {P}, {PX}, g AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x, CAST(k.i AS INTEGER) AS pixel FROM (SELECT unnest(range(0, max(y) + 1)) AS i FROM p) a, (SELECT unnest(range(0, max(x) + 1)) AS i FROM p) b, range(64) k(i)) SELECT g.y, g.x, g.pixel, {R('coalesce(v, 0.0)')} AS v FROM g LEFT JOIN (SELECT * FROM px WHERE idx % 3 <> 0) px ON g.y = px.y AND g.x = px.x AND g.pixel = px.pixel")
def fill_missing(spark, d):
    """Points that aren't there, of the map that the table spans, get patterns of zeros."""
    df = patterns(spark, d)
    return long(selection.fill_missing(df.filter("idx % 3 <> 0"), selection.map_shape(df), 64), "y", "x")


@query("WITH s AS (SELECT CAST(5 + i AS DOUBLE) AS energy, i AS n FROM range(16) t(i)) SELECT energy, n FROM s WHERE abs(energy - 12.4) = (SELECT min(abs(energy - 12.4)) FROM s)")
def nearest_energy(spark, d):
    return selection.nearest_energy(spark.range(16).select((F.col("id") + 5).cast("double").alias("energy"), F.col("id").alias("n")), 12.4)


@query(f"WITH {P} SELECT idx FROM p WHERE phase = 3 AND x < 20")
def points_in_data(spark, d):
    xmap = patterns(spark, d).withColumn("is_in_data", F.col("x") < 20).withColumn("phase_id", F.when(F.col("phase_id") == 3, 3).otherwise(-1))
    return selection.points_in_data(xmap).select("idx")


# Virtual images

@query(f"WITH {P}, {PX} SELECT idx, y, x, {R('sum(v)')} AS v FROM px WHERE r >= 2 AND r < 5 AND c >= 1 AND c < 8 GROUP BY ALL")
def virtual_bse(spark, d):
    return virtual_image(patterns(spark, d), P_SHAPE, (2, 5, 1, 8)).select("idx", "y", "x", r6("v").alias("v"))


@query(f"WITH {P}, {PX} SELECT idx, CAST(r // 2 AS INTEGER) AS grid_r, CAST(c // 2 AS INTEGER) AS grid_c, {R('sum(v)')} AS v FROM px GROUP BY ALL")
def virtual_bse_grid(spark, d):
    return VirtualImager(P_SHAPE, (4, 4)).images(patterns(spark, d)).select("idx", "grid_r", "grid_c", r6("v").alias("v"))


@query(f"WITH {L} SELECT idx, CAST(r AS INTEGER) AS grid_r, CAST(0 AS INTEGER) AS grid_c, {R('sum(v)')} AS v FROM lx GROUP BY idx, r")
def virtual_bse_rows(spark, d):
    return VirtualImager(L_SHAPE, (7, 1)).images(quantities(spark, d)).select("idx", "grid_r", "grid_c", r6("v").alias("v"))


_CHANNELS = [("r", "r < 2 AND c < 2"), ("g", "r >= 2 AND r < 6 AND c >= 2 AND c < 6"), ("b", "r >= 6")]


@query(f"""WITH {P}, {PX}, s AS (SELECT idx, y, x, {', '.join(f'sum(CASE WHEN {w} THEN v ELSE 0 END) AS {n}' for n, w in _CHANNELS)} FROM px GROUP BY ALL),
t AS (SELECT {', '.join(f'median({n}) AS {n}m, stddev_pop({n}) AS {n}s' for n in 'rgb')} FROM s),
n AS (SELECT idx, y, x, {', '.join(f'greatest(least(127 + 255 * 0.3125 * ({n} - {n}m) / {n}s, 255.0), 0.0) AS {n}' for n in 'rgb')} FROM s, t),
e AS (SELECT min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM n) SELECT idx, y, x, {', '.join(R(f'({n} - lo) / (hi - lo) * 255.0') + f' AS {n}' for n in 'rgb')} FROM n, e""")
def virtual_bse_rgb(spark, d):
    out = VirtualImager(P_SHAPE, (4, 4)).rgb(patterns(spark, d).drop("phase_id"), (0, 0), [(1, 1), (1, 2), (2, 1), (2, 2)], (6, 8, 0, 8))
    return out.select("idx", "y", "x", *[r6(n).alias(n) for n in "rgb"])


@query()
def decomposition_model(spark, d):
    return long(decomposition.decomposition_model(patterns(spark, d), 64, 10), "idx")


@query(f"WITH {P}, {PX} SELECT idx, pixel, {R('v')} AS v FROM px")
def decomposition_model_full(spark, d):
    """All components together give the patterns back."""
    return long(decomposition.decomposition_model(patterns(spark, d), 64), "idx")


