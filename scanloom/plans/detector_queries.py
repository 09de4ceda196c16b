"""Queries of detectors, plane fits, master patterns, metrics and virtual images, beyond those on columns alone."""

from __future__ import annotations

import logging
import math
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scanloom import messages
from scanloom.kernels.blocks import map_patterns
from scanloom.operators import calibration, crystal_maps, indexing, refinement, virtual_imaging
from scanloom.operators.detector import Detector
from scanloom.operators.master_pattern import MasterPattern
from scanloom.plans.geometry_queries import DETECTOR, GN, PC, SHAPE
from scanloom.plans.projections import P_SHAPE, patterns, projection_centres, r6
from scanloom.plans.registry import PX, P, R, query
from scanloom.scan import Scan

_PC = ("pcx", "pcy", "pcz")


def _centres(spark, d) -> tuple[np.ndarray, np.ndarray]:
    """(idx, projection centres) of all points, on the driver: what a detector object holds."""
    rows = np.array([tuple(r) for r in projection_centres(spark, d).orderBy("idx").select("idx", *_PC).toLocalIterator()])
    return rows[:, 0].astype(int), rows[:, 1:]


def _table(spark, columns: dict[str, list]):
    kind = lambda v: "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "boolean" if isinstance(v, bool) else "string"
    plain = {k: [x.item() if isinstance(x, np.generic) else x for x in v] for k, v in columns.items()}
    schema = ", ".join(f"{k} {'boolean' if isinstance(v[0], bool) else kind(v[0])}" for k, v in plain.items())
    out = spark.createDataFrame(list(zip(*plain.values(), strict=True)), schema)
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _detector(pc: np.ndarray) -> Detector:
    return Detector(SHAPE, 70.0, 4, 5.0, 2.0, 1.0, 70.0, pc)


@query(f"WITH {P}, {PC} SELECT {R('avg(pcx)')} AS pcx, {R('avg(pcy)')} AS pcy, {R('avg(pcz)')} AS pcz FROM pc")
def detector_mean_pc(spark, d):
    return _table(spark, {c: [v] for c, v in zip(_PC, _detector(_centres(spark, d)[1]).pc_average, strict=True)})


@query(f"WITH {P}, {PC}, {GN} SELECT idx, {R('sqrt(greatest(x0*x0 + y0*y0, x1*x1 + y0*y0, x1*x1 + y1*y1, x0*x0 + y1*y1))')} AS r_max, {R('pcz * 48 * 4 * 70')} AS distance, {R('x1 - x0')} AS width, {R('(y1 - y0) / 47')} AS y_scale FROM g")
def detector_extent(spark, d):
    """Of each projection centre: the farthest corner, the distance from the sample, and the size of the screen."""
    idx, pc = _centres(spark, d)
    det = _detector(pc)
    return _table(spark, {"idx": list(idx), "r_max": list(det.r_max()), "distance": list(det.specimen_scintillator_distance), "width": list(det.x_max - det.x_min), "y_scale": list(det.y_scale)})


#: The frame turns about its own axes: Y, Z, X of the sample first, then by 70 - 5 degrees about the first axis backwards.
_A, _B, _C = math.radians(65), math.radians(2), math.radians(1)
_AXES = f"""f0 AS (SELECT 0.0::DOUBLE AS x1, 1.0::DOUBLE AS y1, 0.0::DOUBLE AS z1, -sin({_A!r}::DOUBLE) AS x2, 0.0::DOUBLE AS y2, cos({_A!r}::DOUBLE) AS z2, cos({_A!r}::DOUBLE) AS x3, 0.0::DOUBLE AS y3, sin({_A!r}::DOUBLE) AS z3),
f1 AS (SELECT cos({_B!r}::DOUBLE) * x1 + sin({_B!r}::DOUBLE) * x3 AS x1, cos({_B!r}::DOUBLE) * y1 + sin({_B!r}::DOUBLE) * y3 AS y1, cos({_B!r}::DOUBLE) * z1 + sin({_B!r}::DOUBLE) * z3 AS z1, x2, y2, z2, cos({_B!r}::DOUBLE) * x3 - sin({_B!r}::DOUBLE) * x1 AS x3, cos({_B!r}::DOUBLE) * y3 - sin({_B!r}::DOUBLE) * y1 AS y3, cos({_B!r}::DOUBLE) * z3 - sin({_B!r}::DOUBLE) * z1 AS z3 FROM f0),
f2 AS (SELECT cos({_C!r}::DOUBLE) * x1 - sin({_C!r}::DOUBLE) * x2 AS x1, cos({_C!r}::DOUBLE) * y1 - sin({_C!r}::DOUBLE) * y2 AS y1, cos({_C!r}::DOUBLE) * z1 - sin({_C!r}::DOUBLE) * z2 AS z1, cos({_C!r}::DOUBLE) * x2 + sin({_C!r}::DOUBLE) * x1 AS x2, cos({_C!r}::DOUBLE) * y2 + sin({_C!r}::DOUBLE) * y1 AS y2, cos({_C!r}::DOUBLE) * z2 + sin({_C!r}::DOUBLE) * z1 AS z2, x3, y3, z3 FROM f1)"""


@query(f"WITH {P}, {_AXES} SELECT idx, {R('p[1] * x1 + p[2] * y1 + p[3] * z1')} AS x, {R('p[1] * x2 + p[2] * y2 + p[3] * z2')} AS y, {R('p[1] * x3 + p[2] * y3 + p[3] * z3')} AS z, -2.0::DOUBLE AS phi1, 95.0::DOUBLE AS Phi, -1.0::DOUBLE AS phi2 FROM p, f2")
def sample_to_detector(spark, d):
    """Vectors of the sample seen in the detector's frame, and the detector's Euler angles."""
    m = DETECTOR.sample_to_detector
    v = [F.col("pixels")[k] for k in range(3)]
    turned = [sum((v[k] * float(row[k]) for k in range(1, 3)), v[0] * float(row[0])) for row in m]
    return patterns(spark, d).select("idx", *[r6(c).alias(n) for c, n in zip(turned, "xyz", strict=True)], *[F.lit(float(a)).alias(n) for a, n in zip(DETECTOR.euler, ("phi1", "Phi", "phi2"), strict=True)])


@query(f"WITH {P}, {PC}, {GN}, c(k, i, j) AS (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 24.0::DOUBLE, 30.0::DOUBLE), (2, 47.5::DOUBLE, 11.25::DOUBLE)) SELECT idx, k AS k, {R('y1 - i * (y1 - y0) / 48')} AS gy, {R('x0 + j * (x1 - x0) / 60')} AS gx, {R('i')} AS back_row, {R('j')} AS back_col FROM g, c".replace("k AS k", "CAST(k AS BIGINT) AS k"))
def detector_coordinates(spark, d):
    """Pixels of the detector as gnomonic coordinates for every projection centre, and back again."""
    idx, pc = _centres(spark, d)
    det, at = _detector(pc), np.array([[0, 0], [24, 30], [47.5, 11.25]])
    there = det.to_gnomonic_coords(at)
    back = det.to_pixel_coords(there[0], 0)
    rows = {"idx": np.repeat(idx, 3), "k": np.tile(np.arange(3), len(idx)), "gy": there[..., 0].ravel(), "gx": there[..., 1].ravel(), "back_row": np.tile(back[:, 0], len(idx)), "back_col": np.tile(back[:, 1], len(idx))}
    return _table(spark, {k: v.tolist() for k, v in rows.items()})


def _fit(transformation: str):
    def f(spark, d):
        """Projection centres on a plane are fitted exactly, from every point, for every point."""
        idx, pc = _centres(spark, d)
        at = np.stack([idx // 25, idx % 25])
        fit, whole, tilt = calibration.fit_pc(pc, at, at[:, :, None], transformation)
        return _table(spark, {"idx": list(idx), **{c: list(whole[:, 0, k]) for k, c in enumerate(_PC)}, "x_tilt": [float(tilt)] * len(idx)})

    f.__name__ = f"fit_pc_to_plane_{transformation}"
    query(f"WITH {P}, {PC}, t AS (SELECT degrees(pi() / 2 + atan(regr_slope(pcy, pcz))) AS x_tilt FROM pc) SELECT idx, {R('pcx')} AS pcx, {R('pcy')} AS pcy, {R('pcz')} AS pcz, {R('x_tilt')} AS x_tilt FROM pc, t")(f)


_fit("affine")
_fit("projective")

#: The plane's normal is the product of its directions along a map row and a map column.
_U, _W = (1 / 1000, 0.0, 1 / 9000), (0.0, -1 / 500, 1 / 800)
_NORMAL = [_U[1] * _W[2] - _U[2] * _W[1], _U[2] * _W[0] - _U[0] * _W[2], _U[0] * _W[1] - _U[1] * _W[0]]
_NORMAL = [-v if _NORMAL[2] < 0 else v for v in _NORMAL]


@query(f"SELECT {R(f'degrees(acos({_NORMAL[2]!r}::DOUBLE / sqrt({_NORMAL[0]!r}::DOUBLE ** 2 + {_NORMAL[1]!r}::DOUBLE ** 2 + {_NORMAL[2]!r}::DOUBLE ** 2)))')} AS x_tilt, {R(f'degrees(pi() / 2 - atan2({_NORMAL[1]!r}::DOUBLE, {_NORMAL[0]!r}::DOUBLE))')} AS z_tilt")
def estimate_xtilt_ztilt(spark, d):
    """Tilts of the plane that the projection centres lie in."""
    x, z = calibration.estimate_xtilt_ztilt(_centres(spark, d)[1], degrees=True)
    return _table(spark, {"x_tilt": [float(x)], "z_tilt": [float(z)]})


@query(f"WITH {P} SELECT idx, idx % 10 = 0 AS outlier, {R('degrees(pi() / 2 + atan(-1.6::DOUBLE))')} AS x_tilt FROM p")
def estimate_xtilt_robust(spark, d):
    """Of projection centres on a line every tenth is moved off it: they are found, and the tilt isn't touched."""
    idx, _ = _centres(spark, d)
    y = idx // 25 + (idx % 25) / 50
    pc = np.column_stack([0 * y, 0.7 - y / 500 + 0.2 * (idx % 10 == 0), 0.5 + y / 800])
    tilt, outlier = calibration.estimate_xtilt_robust(pc, residual=1e-6)
    return _table(spark, {"idx": list(idx), "outlier": outlier.tolist(), "x_tilt": [float(np.rad2deg(tilt))] * len(idx)})


# Scans

@query(f"WITH {P}, {PC} SELECT CAST((y - 2) * 6 + x - 3 AS BIGINT) AS k, {R('pcx')} AS pcx, {R('pcy')} AS pcy, {R('pcz')} AS pcz, CAST(idx AS BIGINT) AS idx, 1.5::DOUBLE AS step FROM pc WHERE y BETWEEN 2 AND 5 AND x BETWEEN 3 AND 8")
def crop_with_attributes(spark, d):
    """A crop of a scan takes its detector's projection centres and its crystal map along, and keeps its calibration."""
    idx, pc = _centres(spark, d)
    ny = int(idx.max()) // 25 + 1
    whole = np.full((ny * 25, 3), np.nan)
    whole[idx] = pc
    points = patterns(spark, d).select("idx", "y", "x")
    scan = Scan(patterns(spark, d), P_SHAPE, nav_shape=(ny, 25), detector=Detector(P_SHAPE, pc=whole.reshape(ny, 25, 3)), xmap=points).set_scan_calibration(1.5, 1.5).crop(2, 6, 3, 9)
    own = _table(spark, {"k": list(range(24)), **{c: list(scan.detector.pc_flattened[:, i]) for i, c in enumerate(_PC)}})
    at = scan.xmap.select("idx", (F.col("y") * 6 + F.col("x")).cast("bigint").alias("k"))
    return own.join(at, "k").withColumn("step", F.lit(float(scan.step[0])))


@query("SELECT 'whole' AS what, TRUE AS fits UNION ALL SELECT 'too few rows', FALSE UNION ALL SELECT 'detector of one centre', TRUE UNION ALL SELECT 'detector of another shape', FALSE UNION ALL SELECT 'equal phases', TRUE UNION ALL SELECT 'other lattice', FALSE UNION ALL SELECT 'other atoms', FALSE")
def compatibility(spark, d):
    """Whether crystal maps and detectors belong to a scan, and whether phases are equal."""
    points = patterns(spark, d).select("idx", "y", "x")
    ny = points.agg(F.max("y")).first()[0] + 1
    nickel = crystal_maps.Phase("ni", 225, (3.52, 3.52, 3.52, 90, 90, 90), (("Ni", 0, 0, 0),))
    same = lambda **k: not crystal_maps.different_in(nickel, crystal_maps.Phase(**{"name": "ni", "space_group": 225, "lattice": nickel.lattice, "atoms": nickel.atoms} | k))
    full = points.filter(F.col("y") < (ny - 1))  # the last row of the map may be short
    found = {
        "whole": crystal_maps.is_compatible(full, ny - 1, 25), "too few rows": crystal_maps.is_compatible(full, ny, 25),
        "detector of one centre": DETECTOR.is_compatible((ny, 25), SHAPE), "detector of another shape": DETECTOR.is_compatible((ny, 25), P_SHAPE),
        "equal phases": same(), "other lattice": same(lattice=(3.6, 3.52, 3.52, 90, 90, 90)), "other atoms": same(atoms=(("Al", 0, 0, 0),)),
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "what string, fits boolean")


# Master patterns

_N = 11
_I = np.arange(_N)
_UPPER, _LOWER = np.cos(_I[:, None] * 0.7) + _I * 0.1, np.sin(_I[:, None] * 0.4) - _I * 0.2
_MASTER = MasterPattern(np.stack([_UPPER, 2 * _UPPER + 1]), np.stack([_LOWER, 3 * _LOWER]), "stereographic", (10.0, 20.0), centrosymmetric=False)
_M = """m AS (SELECT e.i AS e, CAST(a.i AS INTEGER) AS r, CAST(b.i AS INTEGER) AS c, (cos(a.i * 0.7::DOUBLE) + b.i * 0.1::DOUBLE) * (1 + e.i) + e.i AS upper, (sin(a.i * 0.4::DOUBLE) - b.i * 0.2::DOUBLE) * (1 + 2 * e.i) AS lower FROM range(2) e(i), range(11) a(i), range(11) b(i))"""


def _master_table(spark, upper: np.ndarray, lower: np.ndarray):
    e, r, c = (v.ravel() for v in np.indices(upper.shape))
    return _table(spark, {"e": e.tolist(), "r": r.tolist(), "c": c.tolist(), "upper": upper.ravel().tolist(), "lower": lower.ravel().tolist()})


def _cast(sql: str) -> str:
    return f"SELECT CAST(e AS BIGINT) AS e, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, upper, lower FROM ({sql})"


@query(_cast(f"WITH {_M} SELECT CAST(0 AS BIGINT) AS e, r, c, {R('upper')} AS upper, {R('lower')} AS lower FROM m WHERE e = 0"))
def master_at_energy(spark, d):
    """Both hemispheres at the energy nearest to 12 keV."""
    upper, lower = _MASTER.at_energy(12.0)
    return _master_table(spark, upper[None], lower[None])


@query(_cast(f"WITH {_M}, x AS (SELECT e, min(upper) AS a, max(upper) AS b, min(lower) AS f, max(lower) AS g FROM m GROUP BY e) SELECT e, r, c, {R('(upper - a) / (b - a) * 2 - 1')} AS upper, {R('(lower - f) / (g - f) * 2 - 1')} AS lower FROM m JOIN x USING (e)"))
def master_rescaled(spark, d):
    out = _MASTER.rescale_intensity((-1, 1))
    return _master_table(spark, out.upper, out.lower)


@query(_cast(f"WITH {_M}, x AS (SELECT least(min(upper), min(lower)) AS a, greatest(max(upper), max(lower)) AS b FROM m) SELECT e, r, c, {R('(upper - a) / (b - a) * 100')} AS upper, {R('(lower - a) / (b - a) * 100')} AS lower FROM m, x"))
def master_rescaled_relative(spark, d):
    out = _MASTER.rescale_intensity((0, 100), relative=True)
    return _master_table(spark, out.upper, out.lower)


@query(_cast(f"WITH {_M}, x AS (SELECT e, avg(upper) AS a, stddev_pop(upper) AS b, avg(lower) AS f, stddev_pop(lower) AS g FROM m GROUP BY e) SELECT e, r, c, {R('(upper - a) / (2 * b)')} AS upper, {R('(lower - f) / (2 * g)')} AS lower FROM m JOIN x USING (e)"))
def master_normalized(spark, d):
    out = _MASTER.normalize_intensity(num_std=2)
    return _master_table(spark, out.upper, out.lower)


@query(_cast(f"""WITH {_M}, g AS (SELECT a.i AS r, b.i AS c, (b.i - 5) / 5.0::DOUBLE * sqrt(pi() / 2) AS a, (a.i - 5) / 5.0::DOUBLE * sqrt(pi() / 2) AS b FROM range(11) a(i), range(11) b(i)),
j AS (SELECT r, c, abs(a) > abs(b) AS s, CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS j, CASE WHEN abs(a) > abs(b) THEN b ELSE a END AS n FROM g),
t AS (SELECT r, c, s, j, 2 * j * sqrt(greatest(0, pi() - j * j)) / pi() AS q, CASE WHEN j <> 0 THEN n * pi() / 4 / j ELSE 0 END AS w FROM j),
v AS (SELECT r, c, CASE WHEN s THEN q * cos(w) ELSE q * sin(w) END AS x, CASE WHEN s THEN q * sin(w) ELSE q * cos(w) END AS y, 1 - 2 * j * j / pi() AS z FROM t),
k AS (SELECT r, c, (x / (1 + abs(z)) + 1) * 5 AS fx, (y / (1 + abs(z)) + 1) * 5 AS fy FROM v), l AS (SELECT *, CAST(least(greatest(floor(fx + 1e-12), 0), 9) AS INTEGER) AS c0, CAST(least(greatest(floor(fy + 1e-12), 0), 9) AS INTEGER) AS r0 FROM k)
SELECT m1.e AS e, l.r AS r, l.c AS c, {R('(1 - fy + r0) * ((1 - fx + c0) * m1.upper + (fx - c0) * m2.upper) + (fy - r0) * ((1 - fx + c0) * m3.upper + (fx - c0) * m4.upper)')} AS upper, {R('(1 - fy + r0) * ((1 - fx + c0) * m1.lower + (fx - c0) * m2.lower) + (fy - r0) * ((1 - fx + c0) * m3.lower + (fx - c0) * m4.lower)')} AS lower
FROM l JOIN m m1 ON m1.r = r0 AND m1.c = c0 JOIN m m2 ON m2.r = r0 AND m2.c = c0 + 1 AND m2.e = m1.e JOIN m m3 ON m3.r = r0 + 1 AND m3.c = c0 AND m3.e = m1.e JOIN m m4 ON m4.r = r0 + 1 AND m4.c = c0 + 1 AND m4.e = m1.e"""))
def master_as_lambert(spark, d):
    out = _MASTER.as_lambert()
    return _master_table(spark, out.upper, out.lower)


# A metric of one's own

class NegativeDistance(indexing.SimilarityMetric):
    """Greater is closer."""

    def match(self, experimental: np.ndarray, dictionary: np.ndarray) -> np.ndarray:
        squares = (experimental**2).sum(axis=1)[:, None] + (dictionary**2).sum(axis=1)[None] - 2 * experimental @ dictionary.T
        return -np.sqrt(np.maximum(squares, 0))


@query(f"WITH {P}, {PX}, s AS (SELECT a.idx AS idx, b.idx AS sim_idx, -sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.p[i] - b.p[i]) * (a.p[i] - b.p[i])))) AS score FROM p a, p b), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC) AS rank FROM s) SELECT idx, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score FROM r WHERE rank <= 3")
def dictionary_indexing_own_metric(spark, d):
    """All patterns against all, by distance; the nearest to each is itself."""
    p = patterns(spark, d)
    found = indexing.dictionary_indexing(p, p.select(F.col("idx").alias("sim_idx"), "pixels"), 64, NegativeDistance(), keep_n=3)
    return found.select("idx", F.posexplode("scores").alias("rank", "score")).select("idx", (F.col("rank") + 1).cast("bigint").alias("rank"), F.round(F.col("score").cast("double"), 4).alias("score"))


# Virtual images

_IMAGE = f"WITH {P}, {PX}, v AS (SELECT idx, sum(v) AS v FROM px WHERE r BETWEEN 2 AND 4 AND c BETWEEN 1 AND 6 GROUP BY idx)"


def _image(spark, d):
    return virtual_imaging.virtual_image(patterns(spark, d), P_SHAPE, (2, 5, 1, 7)).select("idx", "v")


@query(f"{_IMAGE}, x AS (SELECT min(v) AS a, max(v) AS b FROM v) SELECT idx, {R('(v - a) / (b - a) * 255')} AS v FROM v, x")
def virtual_image_rescaled(spark, d):
    return virtual_imaging.rescale_image(_image(spark, d), (0, 255)).select("idx", r6("v").alias("v"))


@query(f"{_IMAGE}, x AS (SELECT avg(v) AS a, stddev_pop(v) AS b FROM v) SELECT idx, {R('(v - a) / b')} AS v FROM v, x")
def virtual_image_normalized(spark, d):
    return virtual_imaging.normalize_image(_image(spark, d)).select("idx", r6("v").alias("v"))


@query("SELECT CAST(r.i AS BIGINT) AS r, CAST(c.i AS BIGINT) AS c, CAST(r.i * 48 // 5 AS BIGINT) AS top, CAST((r.i + 1) * 48 // 5 AS BIGINT) AS bottom, CAST(c.i * 60 // 4 AS BIGINT) AS left_, CAST((c.i + 1) * 60 // 4 AS BIGINT) AS right_ FROM range(5) r(i), range(4) c(i)")
def virtual_detector_regions(spark, d):
    """The tiles of a screen of 48 x 60 pixels."""
    imager = virtual_imaging.VirtualImager(SHAPE, (5, 4))
    return spark.createDataFrame([(r, c, *imager.region((r, c))) for r in range(5) for c in range(4)], "r bigint, c bigint, top bigint, bottom bigint, left_ bigint, right_ bigint")


# Single patterns

_OTHER = np.cos(np.arange(64) * 0.37)


@query(f"WITH {P}, {PX}, o AS (SELECT idx, corr(v, cos(pixel * 0.37::DOUBLE)) AS c FROM px GROUP BY idx) SELECT idx, {R('c')} AS ncc FROM o")
def pattern_correlation(spark, d):
    """Each pattern against one other, as refinement compares them."""
    out = StructType([StructField("ncc", DoubleType())])
    return map_patterns(patterns(spark, d), lambda b: {"ncc": refinement.correlation(b, _OTHER)}, out, 64).select("idx", r6("ncc").alias("ncc"))


@query("SELECT 'DEBUG' AS level, 10 AS number UNION ALL SELECT 'WARNING', 30")
def log_levels(spark, d):
    """The level of the engine's messages."""
    rows = []
    for level in ("DEBUG", "WARNING"):
        messages.set_log_level(level)
        rows.append((level, logging.getLogger("scanloom").level))
    return spark.createDataFrame(rows, "level string, number int")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'patterns' AS what, n::BIGINT AS number FROM n UNION ALL SELECT 'dictionary', n FROM n UNION ALL SELECT 'comparisons', n * n FROM n UNION ALL SELECT 'kept', 20")
def dictionary_indexing_message(spark, d):
    """What is said before patterns are matched."""
    n = patterns(spark, d).count()
    text = messages.indexing_message(n, n, 64, 20, "NormalizedCrossCorrelation")
    found = {k: int(v.replace(" ", "")) for k, v in re.findall(r"^(\w+): ([\d ]+)$", text, re.M)}
    return spark.createDataFrame([(k, found[k]) for k in ("patterns", "dictionary", "comparisons", "kept")], "what string, number bigint")
