"""Queries of rotations, detectors, calibration, simulation and refinement."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.operators import calibration, master_pattern, refinement, simulation
from scanloom.operators.detector import Detector, convert_pc
from scanloom.plans.projections import angles, patterns, projection_centres, r6
from scanloom.plans.registry import P, R, query

SHAPE = (48, 60)
DETECTOR = Detector(SHAPE, px_size=70.0, binning=4, tilt=5.0, azimuthal=2.0, twist=1.0, sample_tilt=70.0, pc=np.array([0.42, 0.78, 0.5]))
PC = "pc AS (SELECT idx, y, x, 0.4 + x / 1000.0 AS pcx, 0.7 - y / 500.0 AS pcy, 0.5 + y / 800.0 + x / 9000.0 AS pcz FROM p)"
PC = PC.replace("0.4 +", "CAST(0.4 AS DOUBLE) +").replace("0.7 -", "CAST(0.7 AS DOUBLE) -").replace("0.5 +", "CAST(0.5 AS DOUBLE) +")
GN = "g AS (SELECT *, -1.25 * pcx / pcz AS x0, 1.25 * (1 - pcx) / pcz AS x1, -(1 - pcy) / pcz AS y0, pcy / pcz AS y1 FROM pc)"
ANGLES = "an AS (SELECT idx, idx * CAST(0.013 AS DOUBLE) AS a1, y * CAST(0.07 AS DOUBLE) + 0.1 AS a2, x * CAST(0.21 AS DOUBLE) AS a3 FROM p)"
QUATERNION = """q0 AS (SELECT idx, cos(a2 / 2) * cos((a1 + a3) / 2) AS a, -sin(a2 / 2) * cos((a1 - a3) / 2) AS b, -sin(a2 / 2) * sin((a1 - a3) / 2) AS c, -cos(a2 / 2) * sin((a1 + a3) / 2) AS d FROM an),
q AS (SELECT idx, CASE WHEN a < 0 THEN -a ELSE a END AS a, CASE WHEN a < 0 THEN -b ELSE b END AS b, CASE WHEN a < 0 THEN -c ELSE c END AS c, CASE WHEN a < 0 THEN -d ELSE d END AS d FROM q0)"""


def _rounded(**columns: str) -> str:
    return ", ".join(f"{R(v)} AS {k}" for k, v in columns.items())


def _named(names: str, columns) -> list:
    return [r6(c).alias(n) for n, c in zip(names.split(), columns, strict=True)]


def _quaternions(spark, d):
    df = angles(spark, d)
    q = geo.euler_to_quaternion(F.col("phi1"), F.col("Phi"), F.col("phi2"))
    return df.select("idx", *[c.alias(n) for n, c in zip("abcd", q, strict=True)])


# Rotations and projections

@query(f"WITH {P}, {ANGLES}, {QUATERNION} SELECT idx, {_rounded(a='a', b='b', c='c', d='d')} FROM q")
def euler_to_quaternion(spark, d):
    return _quaternions(spark, d).select("idx", *_named("a b c d", [F.col(n) for n in "abcd"]))


@query(f"WITH {P}, v AS (SELECT idx, p[1] * 3 AS x, p[2] * 3 AS y, p[3] * 3 AS z FROM p), n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v) SELECT idx, {_rounded(a='cos(atan(n))', b='sin(atan(n)) * x / n', c='sin(atan(n)) * y / n', d='sin(atan(n)) * z / n')} FROM n")
def rodrigues_to_quaternion(spark, d):
    v = [F.col("pixels")[k] * 3 for k in range(3)]
    return patterns(spark, d).select("idx", *_named("a b c d", geo.rodrigues_to_quaternion(*v)))


_V = "v AS (SELECT idx, p[1] AS x, p[2] AS y, p[3] AS z FROM p)"
_TURNED = {
    "x": "(a*a + b*b - c*c - d*d) * x + 2 * (b*c - a*d) * y + 2 * (b*d + a*c) * z",
    "y": "2 * (b*c + a*d) * x + (a*a - b*b + c*c - d*d) * y + 2 * (c*d - a*b) * z",
    "z": "2 * (b*d - a*c) * x + 2 * (c*d + a*b) * y + (a*a - b*b - c*c + d*d) * z",
}


@query(f"WITH {P}, {ANGLES}, {QUATERNION}, {_V} SELECT idx, {_rounded(**_TURNED)} FROM q JOIN v USING (idx)")
def rotate_vector(spark, d):
    q = geo.euler_to_quaternion(F.col("phi1"), F.col("Phi"), F.col("phi2"))
    df = angles(spark, d).join(patterns(spark, d).select("idx", "pixels"), "idx")
    return df.select("idx", *_named("x y z", geo.rotate_vector(q, tuple(F.col("pixels")[k] for k in range(3)))))


@query(f"WITH {P}, {_V} SELECT idx, {_rounded(x='x * cos(0.7) - y * sin(0.7)', y='x * sin(0.7) + y * cos(0.7)', z='z')} FROM v")
def rotate_about_axis(spark, d):
    v = tuple(F.col("pixels")[k] for k in range(3))
    return patterns(spark, d).select("idx", *_named("x y z", geo.rotate_about_axis(v, (0, 0, 2), 0.7)))


_N = "n AS (SELECT idx, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM v)"
_LAMBERT = """lam AS (SELECT *, CASE WHEN abs(y) <= abs(x) THEN sign(x) * sqrt(2 * (1 - abs(z))) * sqrt(pi()) / 2 ELSE sign(y) * sqrt(2 * (1 - abs(z))) * 2 / sqrt(pi()) * atan(x / y) END AS lx,
CASE WHEN abs(y) <= abs(x) THEN sign(x) * sqrt(2 * (1 - abs(z))) * 2 / sqrt(pi()) * atan(y / x) ELSE sign(y) * sqrt(2 * (1 - abs(z))) * sqrt(pi()) / 2 END AS ly FROM n)"""


@query(f"WITH {P}, {_V}, {_N}, {_LAMBERT} SELECT idx, {_rounded(lx='lx', ly='ly')} FROM lam")
def vector_to_lambert(spark, d):
    v = [F.col("pixels")[k] for k in range(3)]
    return patterns(spark, d).select("idx", *_named("lx ly", geo.vector_to_lambert(*v)))


@query(f"""WITH {P}, v AS (SELECT idx, p[1] * sqrt(pi() / 2) AS a, p[2] * sqrt(pi() / 2) AS b FROM p), m AS (SELECT idx, abs(a) > abs(b) AS s, CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS j, CASE WHEN abs(a) > abs(b) THEN b ELSE a END AS n FROM v),
t AS (SELECT idx, s, j, 2 * j * sqrt(pi() - j * j) / pi() AS q, CASE WHEN j <> 0 THEN n * pi() / 4 / j ELSE 0 END AS w FROM m)
SELECT idx, {_rounded(x='CASE WHEN s THEN q * cos(w) ELSE q * sin(w) END', y='CASE WHEN s THEN q * sin(w) ELSE q * cos(w) END', z='1 - 2 * j * j / pi()')} FROM t""")
def lambert_to_vector(spark, d):
    return patterns(spark, d).select("idx", *_named("x y z", geo.lambert_to_vector(F.col("pixels")[0], F.col("pixels")[1])))


# Detectors

@query(f"WITH {P}, {PC}, {GN} SELECT idx, {_rounded(x0='x0', x1='x1', y0='y0', y1='y1')} FROM g")
def gnomonic_bounds(spark, d):
    return projection_centres(spark, d).select("idx", *_named("x0 x1 y0 y1", geo.gnomonic_bounds(SHAPE, F.col("pcx"), F.col("pcy"), F.col("pcz"))))


def _bounds():
    return geo.gnomonic_bounds(SHAPE, F.col("pcx"), F.col("pcy"), F.col("pcz"))


@query(f"WITH {P}, {PC}, {GN} SELECT idx, {_rounded(x='(x1 - x0) / 59', y='(y1 - y0) / 47')} FROM g")
def gnomonic_scale(spark, d):
    return projection_centres(spark, d).select("idx", *_named("x y", geo.gnomonic_scale(SHAPE, _bounds())))


@query(f"WITH {P}, {PC}, {GN} SELECT idx, {_rounded(gy='y1 - y * (y1 - y0) / 48', gx='x0 + x * (x1 - x0) / 60')} FROM g")
def pixel_to_gnomonic(spark, d):
    return projection_centres(spark, d).select("idx", *_named("gy gx", geo.pixel_to_gnomonic(SHAPE, _bounds(), F.col("y"), F.col("x"))))


@query(f"WITH {P}, {PC}, {GN} SELECT idx, {_rounded(row='(y1 - x / 50.0) * 48 / (y1 - y0)', col='(y / 50.0 - x0) * 60 / (x1 - x0)')} FROM g")
def gnomonic_to_pixel(spark, d):
    return projection_centres(spark, d).select("idx", *_named("row col", geo.gnomonic_to_pixel(SHAPE, _bounds(), F.col("x") / 50.0, F.col("y") / 50.0)))


_CONVERTED = {
    "tsl": ("pcx", "1 - pcy", "pcz / (48.0 / 48.0)"),
    "oxford": ("pcx", "(1 - pcy) / 1.25", "pcz / 1.25"),
    "emsoft4": ("-(0.5 - pcx) * 60 * 4", "(0.5 - pcy) * 48 * 4", "pcz * 48 * 4 * 70"),
    "emsoft": ("(0.5 - pcx) * 60 * 4", "(0.5 - pcy) * 48 * 4", "pcz * 48 * 4 * 70"),
}


def _convert(name: str):
    x, y, z = _CONVERTED[name]

    def to(spark, d):
        return convert_pc(projection_centres(spark, d), DETECTOR, "bruker", name).select("idx", *_named("pcx pcy pcz", [F.col(c) for c in ("pcx", "pcy", "pcz")]))

    def back(spark, d):
        there = convert_pc(projection_centres(spark, d), DETECTOR, "bruker", name)
        return convert_pc(there, DETECTOR, name, "bruker").select("idx", *_named("pcx pcy pcz", [F.col(c) for c in ("pcx", "pcy", "pcz")]))

    to.__name__, back.__name__ = f"pc_bruker_to_{name}", f"pc_{name}_to_bruker"
    query(f"WITH {P}, {PC} SELECT idx, {_rounded(pcx=x, pcy=y, pcz=z)} FROM pc")(to)
    query(f"WITH {P}, {PC} SELECT idx, {_rounded(pcx='pcx', pcy='pcy', pcz='pcz')} FROM pc")(back)


for _name in _CONVERTED:
    _convert(_name)


@query(f"WITH {P}, {PC} SELECT idx, {_rounded(pcx='(pcx * 60 - 6) / 44', pcy='(pcy * 48 - 4) / 30', pcz='pcz * 48 / 30')} FROM pc")
def crop_pc(spark, d):
    return projection_centres(spark, d).select("idx", *_named("pcx pcy pcz", geo.crop_pc(SHAPE, (4, 34, 6, 50), F.col("pcx"), F.col("pcy"), F.col("pcz"))))


_EXTRAPOLATED = {
    "pcx": "(CAST(0.41 AS DOUBLE) + 0.43) / 2 + (12 - x.i) * 1.5 / (70.0 * 4 * 60)",
    "pcy": "(CAST(0.7 AS DOUBLE) + 0.72) / 2 + (10 - y.i) * 1.5 * cos(radians(25)) / (70.0 * 4 * 48)",
    "pcz": "(CAST(0.5 AS DOUBLE) + 0.52) / 2 - (10 - y.i) * 1.5 * sin(radians(25)) / (70.0 * 4 * 48)",
}


@query(f"SELECT CAST(y.i AS INTEGER) AS y, CAST(x.i AS INTEGER) AS x, {_rounded(**_EXTRAPOLATED)} FROM range(20) y(i), range(25) x(i)")
def extrapolate_pc(spark, d):
    detector = Detector(SHAPE, 70.0, 4, 5.0, sample_tilt=70.0, pc=np.array([[0.41, 0.7, 0.5], [0.43, 0.72, 0.52]]))
    out = detector.extrapolate_pc(spark, np.array([[0, 20], [0, 24]]), (20, 25), (1.5, 1.5))
    return out.select("y", "x", *_named("pcx pcy pcz", [F.col(c) for c in ("pcx", "pcy", "pcz")]))


@query(f"WITH {P}, {PC} SELECT {R('degrees(pi() / 2 + atan(regr_slope(pcy, pcz)))')} AS x_tilt FROM pc")
def estimate_xtilt(spark, d):
    return calibration.estimate_xtilt(projection_centres(spark, d), degrees=True).select(r6("x_tilt").alias("x_tilt"))


def _affine_sql() -> str:
    one = """SELECT '{p}' AS pc, (y_p * x_x - x_p * y_x) / (y_y * x_x - y_x * y_x) AS row, (x_p * y_y - y_p * y_x) / (y_y * x_x - y_x * y_x) AS col, mp, my, mx FROM
(SELECT var_pop(CAST(y AS DOUBLE)) AS y_y, var_pop(CAST(x AS DOUBLE)) AS x_x, covar_pop(y, x) AS y_x, covar_pop(y, {p}) AS y_p, covar_pop(x, {p}) AS x_p, avg({p}) AS mp, avg(y) AS my, avg(x) AS mx FROM n)"""
    union = " UNION ALL ".join(one.format(p=p) for p in ("pcx", "pcy", "pcz"))
    return f"WITH {P}, {PC}, n AS (SELECT y, x, pcx + p[1] / 100 AS pcx, pcy + p[2] / 100 AS pcy, pcz + p[3] / 100 AS pcz FROM pc JOIN p USING (idx, y, x)), f AS ({union}) SELECT pc, {_rounded(row='row', col='col', const='mp - row * my - col * mx')} FROM f"


@query(_affine_sql())
def fit_pc_affine(spark, d):
    noise = patterns(spark, d).select("idx", "pixels")
    df = projection_centres(spark, d).join(noise, "idx").withColumns({n: F.col(n) + F.col("pixels")[k] / 100 for k, n in enumerate(("pcx", "pcy", "pcz"))})
    return calibration.fit_pc_affine(df).select("pc", *_named("row col const", [F.col(c) for c in ("row", "col", "const")]))


_IN = [(109, 131), (390, 139), (246, 232), (129, 228), (364, 237)]
_OUT = [(77, 146), (424, 156), (246, 269), (104, 265), (392, 276)]
_POINTS = ", ".join(f"({k}, {a}.0, {b}.0, {c}.0, {e}.0)" for k, ((a, b), (c, e)) in enumerate(zip(_IN, _OUT, strict=True)))


@query(f"""WITH t(k, xi, yi, xo, yo) AS (VALUES {_POINTS}), d AS (SELECT k, CAST(xi AS DOUBLE) AS xi, CAST(yi AS DOUBLE) AS yi, CAST(xo AS DOUBLE) AS xo, CAST(yo AS DOUBLE) AS yo FROM t),
m AS (SELECT a.k AS i, b.k AS j, a.xo * a.yi - a.yo * a.xi AS da, b.xo * b.yi - b.yo * b.xi AS db, a.xo - a.xi AS ax, a.yo - a.yi AS ay, b.xo - b.xi AS bx, b.yo - b.yi AS by_,
 5 / (sqrt(pow(a.xo - b.xo, 2) + pow(a.yo - b.yo, 2)) / sqrt(pow(a.xi - b.xi, 2) + pow(a.yi - b.yi, 2)) - 1) AS z FROM d a JOIN d b ON a.k < b.k),
s AS (SELECT i, j, (da * bx - ax * db) / (ax * by_ - ay * bx) AS px, (da * by_ - ay * db) / (ax * by_ - ay * bx) AS py, z FROM m)
SELECT i, j, {_rounded(pcx='px / 480', pcy='1 - py / 480', pcz='z')} FROM s WHERE px > 0 AND px < 480 AND py > 0 AND py < 480""")
def pc_moving_screen(spark, d):
    out = calibration.moving_screen(calibration.points_table(spark, _IN, _OUT), (480, 480), 5)
    return out.select("i", "j", *_named("pcx pcy pcz", [F.col(c) for c in ("pcx", "pcy", "pcz")]))


_M = DETECTOR.sample_to_detector.tolist()


def _from_detector(x: str, y: str, z: str) -> dict[str, str]:
    return {n: f"({x}) * ({_M[0][k]!r}::DOUBLE) + ({y}) * ({_M[1][k]!r}::DOUBLE) + ({z}) * ({_M[2][k]!r}::DOUBLE)" for k, n in enumerate("xyz")}


def _to_detector(v: tuple[str, str, str]) -> dict[str, str]:
    return {f"d{n}": " + ".join(f"({c}) * ({_M[k][i]!r}::DOUBLE)" for i, c in enumerate(v)) for k, n in enumerate("xyz")}


_GX, _GY = "(x0 + (x1 - x0) * (x + 0.5) / 60)", "(y1 - (y1 - y0) * (y + 0.5) / 48)"
_COSINES = {k: f"({v}) / sqrt({_GX} * {_GX} + {_GY} * {_GY} + 1)" for k, v in _from_detector(_GX, _GY, "1.0").items()}


@query(f"WITH {P}, {PC}, {GN} SELECT idx, {_rounded(**{'v' + k: v for k, v in _COSINES.items()})} FROM g")
def direction_cosines(spark, d):
    """Of the pixel (y, x) of each point's own detector."""
    pc = tuple(F.col(c) for c in ("pcx", "pcy", "pcz"))
    return projection_centres(spark, d).select("idx", *_named("vx vy vz", geo.direction_cosine(SHAPE, pc, _M, F.col("y"), F.col("x"))))


# Simulation

HKL = np.array([[1, 1, 1], [2, 0, 0], [2, 2, 0], [1, -1, 1], [0, 2, 0], [-1, 1, 1], [0, 2, 2], [3, 1, 1], [-1, -1, 1], [0, 0, 2]])
REFLECTORS = simulation.Reflectors(HKL, (3.5236, 3.5236, 3.5236, 90, 90, 90), np.arange(1.0, 11.0)).with_theta(0.0859)
_REFLECTORS = ", ".join(f"({h}, {k}, {ll}, {float(f)!r}::DOUBLE, {float(t)!r}::DOUBLE)" for (h, k, ll), f, t in zip(HKL, REFLECTORS.structure_factor, REFLECTORS.theta, strict=True))
_HKL = f"hkl(h, k, l, f, t) AS (VALUES {_REFLECTORS})"
_UNIT = "u AS (SELECT *, h / sqrt(h*h + k*k + l*l) AS ux, k / sqrt(h*h + k*k + l*l) AS uy, l / sqrt(h*h + k*k + l*l) AS uz FROM hkl)"


@query(f"""WITH {_HKL}, {_UNIT}, g0 AS (SELECT a.i AS r, b.i AS c, (b.i - 10) / 10.0 AS x, (a.i - 10) / 10.0 AS y FROM range(21) a(i), range(21) b(i)), g AS (SELECT r, c, 2 * x / (1 + x*x + y*y) AS x, 2 * y / (1 + x*x + y*y) AS y, (1 - x*x - y*y) / (1 + x*x + y*y) AS z FROM g0),
s AS (SELECT r, c, f, t, ux * x + uy * y + uz * z AS d FROM g, u) SELECT 'upper' AS hemisphere, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {R('sum(CASE WHEN abs(d) <= 1e-7 THEN f * f / 2 WHEN acos(greatest(least(d, 1.0), -1.0)) BETWEEN pi() / 2 - t AND pi() / 2 THEN f * f ELSE 0.0 END)')} AS intensity FROM s GROUP BY r, c""")
def kinematical_master(spark, d):
    out = simulation.kinematical_master(spark, REFLECTORS, 10, scaling="square")
    return out.select("hemisphere", "r", "c", r6("intensity").alias("intensity"))


_BACK = {k: v.replace("a*d", "(-a*d)").replace("a*c", "(-a*c)").replace("a*b", "(-a*b)") for k, v in _TURNED.items()}


def _seen(vectors: str, keys: str, x: str, y: str, z: str) -> str:
    turned = ", ".join(f"{v} AS t{k}" for k, v in _BACK.items())
    onto = ", ".join(f"{v} AS {k}" for k, v in _to_detector(("tx", "ty", "tz")).items())
    return f"w AS (SELECT idx, {keys}, {turned} FROM (SELECT q.*, {keys}, {x} AS x, {y} AS y, {z} AS z FROM q, {vectors})), o AS (SELECT idx, {keys}, {onto} FROM w)"


_RMAX = float(np.max(DETECTOR.r_max()))


@query(f"""WITH {P}, {ANGLES}, {QUATERNION}, {_HKL}, {_UNIT}, {_seen('u', 'h, k, l', 'ux', 'uy', 'uz')}, e AS (SELECT *, dz / sqrt(dx*dx + dy*dy) AS hesse FROM o WHERE dz > 0), z AS (SELECT *, atan2(dy, dx) - pi() AS az, acos(hesse / ({_RMAX!r}::DOUBLE)) AS al FROM e WHERE abs(hesse) < ({_RMAX!r}::DOUBLE))
SELECT idx, h, k, l, {_rounded(hesse='hesse', x0=f'({_RMAX!r}::DOUBLE) * cos(az + al)', y0=f'({_RMAX!r}::DOUBLE) * sin(az + al)', x1=f'({_RMAX!r}::DOUBLE) * cos(az - al)', y1=f'({_RMAX!r}::DOUBLE) * sin(az - al)')} FROM z""")
def bands_on_detector(spark, d):
    out = simulation.bands_on_detector(_quaternions(spark, d), REFLECTORS, DETECTOR)
    return out.select("idx", "h", "k", "l", *_named("hesse x0 y0 x1 y1", [F.col(c) for c in ("hesse", "x0", "y0", "x1", "y1")]))


_B = [float(v) for v in DETECTOR.gnomonic_bounds.reshape(-1, 4)[0]]


def _pixel(gx: str, gy: str) -> tuple[str, str]:
    return f"({gx} - ({_B[0]!r}::DOUBLE)) * 60 / ({_B[1] - _B[0]!r}::DOUBLE)", f"(({_B[3]!r}::DOUBLE) - {gy}) * 48 / ({_B[3] - _B[2]!r}::DOUBLE)"


_ENDS = {n: p for k, s in enumerate("+-") for n, p in zip((f"x{k}", f"y{k}"), _pixel(f"({_RMAX!r}::DOUBLE) * cos(az {s} al)", f"({_RMAX!r}::DOUBLE) * sin(az {s} al)"), strict=True)}


@query(f"""WITH {P}, {ANGLES}, {QUATERNION}, {_HKL}, {_UNIT}, {_seen('u', 'h, k, l', 'ux', 'uy', 'uz')}, e AS (SELECT *, dz / sqrt(dx*dx + dy*dy) AS hesse FROM o WHERE dz > 0), z AS (SELECT *, atan2(dy, dx) - pi() AS az, acos(hesse / ({_RMAX!r}::DOUBLE)) AS al FROM e WHERE abs(hesse) < ({_RMAX!r}::DOUBLE))
SELECT idx, h, k, l, {_rounded(**_ENDS)} FROM z""")
def band_lines_in_pixels(spark, d):
    """The ends of bands' centre lines as pixels (column, row), for drawing."""
    out = simulation.to_pixels(simulation.bands_on_detector(_quaternions(spark, d), REFLECTORS, DETECTOR), DETECTOR, (("x0", "y0"), ("x1", "y1")))
    return out.select("idx", "h", "k", "l", *_named("x0 y0 x1 y1", [F.col(c) for c in ("x0", "y0", "x1", "y1")]))


_XR, _YR = DETECTOR.x_range[0], DETECTOR.y_range[0]
_SX, _SY = float(DETECTOR.x_scale[0]), float(DETECTOR.y_scale[0])


@query(f"""WITH {P}, {ANGLES}, {QUATERNION}, {_HKL}, pairs AS (SELECT DISTINCT a.k * b.l - a.l * b.k AS u, a.l * b.h - a.h * b.l AS v, a.h * b.k - a.k * b.h AS w FROM hkl a, hkl b),
za AS (SELECT DISTINCT u // gcd(gcd(u, v), w) AS u, v // gcd(gcd(u, v), w) AS v, w // gcd(gcd(u, v), w) AS w FROM pairs WHERE u <> 0 OR v <> 0 OR w <> 0), {_seen('za', 'u, v, w', 'CAST(u AS DOUBLE)', 'CAST(v AS DOUBLE)', 'CAST(w AS DOUBLE)').replace('w AS (', 'tw AS (', 1).replace('FROM w)', 'FROM tw)')},
e AS (SELECT idx, u, v, w, dx / dz AS x, dy / dz AS y FROM o WHERE dz > 0) SELECT idx, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(w AS INTEGER) AS w, {_rounded(x='x', y='y')} FROM e
WHERE x BETWEEN {float(_XR[0]) - _SX!r} AND {float(_XR[1]) + _SX!r} AND y BETWEEN {float(_YR[0]) - _SY!r} AND {float(_YR[1]) + _SY!r} AND sqrt(x*x + y*y) < {_RMAX!r}""")
def zone_axes_on_detector(spark, d):
    out = simulation.zone_axes_on_detector(_quaternions(spark, d), REFLECTORS, DETECTOR)
    return out.select("idx", "u", "v", "w", *_named("x y", [F.col(c) for c in ("x", "y")]))


_I = np.arange(11)
MASTER = master_pattern.MasterPattern(np.cos(_I[:, None] * 0.7) + _I * 0.1, np.sin(_I[:, None] * 0.4) - _I * 0.2, "lambert", (20.0,), centrosymmetric=False)
SMALL = Detector((6, 8), pc=np.array([0.42, 0.78, 0.5]), tilt=5.0, azimuthal=2.0, twist=1.0)


@query(f"""WITH {P}, {ANGLES}, {QUATERNION}, g AS (SELECT r.i AS y, c.i AS x, -(8 / 6.0) * 0.42::DOUBLE / 0.5 AS x0, (8 / 6.0) * (1 - 0.42::DOUBLE) / 0.5 AS x1, -(1 - 0.78::DOUBLE) / 0.5 AS y0, 0.78::DOUBLE / 0.5 AS y1 FROM range(6) r(i), range(8) c(i)),
k AS (SELECT CAST(y * 8 + x AS INTEGER) AS pixel, {', '.join(f'{v} AS c{n}' for n, v in _COSINES.items()).replace('/ 60)', '/ 8)').replace('/ 48)', '/ 6)')} FROM g),
v AS (SELECT idx, pixel, {', '.join(f'{e} AS {n}' for n, e in _TURNED.items())} FROM (SELECT q.*, pixel, cx AS x, cy AS y, cz AS z FROM q, k)),
n AS (SELECT idx, pixel, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM v), {_LAMBERT},
s AS (SELECT idx, pixel, z >= 0 AS up, lx / sqrt(pi() / 2) * 5 + 5 AS j, ly / sqrt(pi() / 2) * 5 + 5 AS i FROM lam),
t AS (SELECT *, least(greatest(CAST(trunc(i) AS INTEGER), 0), 10) AS i0, least(greatest(CAST(trunc(j) AS INTEGER), 0), 10) AS j0 FROM s), t2 AS (SELECT *, least(i0 + 1, 10) AS i1, least(j0 + 1, 10) AS j1, i - i0 AS fi, j - j0 AS fj FROM t),
m AS (SELECT a.i AS i, b.i AS j, cos(a.i * 0.7) + b.i * 0.1 AS u, sin(a.i * 0.4) - b.i * 0.2 AS l FROM range(11) a(i), range(11) b(i))
SELECT idx, pixel, {R('(1 - fi) * (1 - fj) * CASE WHEN up THEN a.u ELSE a.l END + fi * (1 - fj) * CASE WHEN up THEN b.u ELSE b.l END + (1 - fi) * fj * CASE WHEN up THEN c.u ELSE c.l END + fi * fj * CASE WHEN up THEN d.u ELSE d.l END')} AS v
FROM t2 JOIN m a ON a.i = i0 AND a.j = j0 JOIN m b ON b.i = i1 AND b.j = j0 JOIN m c ON c.i = i0 AND c.j = j1 JOIN m d ON d.i = i1 AND d.j = j1""")
def simulate_patterns(spark, d):
    from scanloom.plans.projections import long

    return long(MASTER.get_patterns(_quaternions(spark, d), SMALL), "idx")


@query(f"""WITH g AS (SELECT i AS sim_idx, radians((i // (7 * 12)) * 30.0) AS a1, radians((i // 12 % 7) * 30.0) AS a2, radians((i % 12) * 30.0) AS a3 FROM range(1008) t(i)), an AS (SELECT sim_idx AS idx, a1, a2, a3 FROM g), {QUATERNION}
SELECT idx AS sim_idx, {_rounded(a='a', b='abs(b)', c='abs(c)', d='abs(d)')} FROM q""")
def euler_grid(spark, d):
    """Magnitudes only: where the scalar part is zero up to rounding, engines differ in its sign."""
    return master_pattern.euler_grid(spark, 30).select("sim_idx", *_named("a b c d", [F.abs(n) for n in "abcd"]))


def _simulated(spark, d):
    """Simulated patterns and orientations a little off: one for each row of the table, or sixteen if there is none."""
    grid = _quaternions(spark, d) if d else spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(_some_rotations())], "idx bigint, a double, b double, c double, d double")
    rows = grid.count()  # a row takes long to refine: they are dealt out evenly, whatever files they come from
    tasks = max(-(-rows // 512), min(spark.sparkContext.defaultParallelism, -(-rows // 64)), 1)
    seen = _BANDS.get_patterns(grid.repartition(tasks), _SCREEN)
    tilt = math.radians(0.8)
    q = (F.cos(F.lit(tilt / 2)), F.sin(F.lit(tilt / 2)))
    a, b, c, e = (F.col(n) for n in "abcd")
    moved = {"a": a * q[0] - b * q[1], "b": b * q[0] + a * q[1], "c": c * q[0] - e * q[1], "d": e * q[0] + c * q[1]}
    return seen, moved


def _some_rotations() -> np.ndarray:
    q = np.random.default_rng(5).normal(size=(16, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(q[:, :1] < 0, -q, q)


def _band_master(n: int = 101) -> np.ndarray:
    """A smooth master pattern of a few bands in the Lambert projection."""
    from scanloom.kernels import geometry as kg

    at = np.linspace(-1, 1, n)
    x, y = np.meshgrid(at, at)
    v = kg.lambert_to_vector(np.stack([x, y], axis=-1))
    return sum(f * np.exp(-((v @ u) ** 2) / 0.02) for u, f in zip(REFLECTORS.vectors, REFLECTORS.structure_factor, strict=True))


_BANDS = master_pattern.MasterPattern(_band_master(), projection="lambert", energies=(20.0,))
_SCREEN = Detector((24, 24), pc=np.array([0.45, 0.72, 0.55]))


@query()
def refine_orientation(spark, d):
    seen, moved = _simulated(spark, d)
    out = refinement.refine_orientation(seen.withColumns(moved), _SCREEN, _BANDS, trust_region=(3, 3, 3))
    return out.select("idx", F.round("score", 3).alias("score"))


@query()
def refine_projection_center(spark, d):
    seen, _ = _simulated(spark, d)
    out = refinement.refine_projection_center(seen, _SCREEN.with_pc([0.46, 0.71, 0.56]), _BANDS, trust_region=(0.05, 0.05, 0.05))
    return out.select("idx", F.round("score", 3).alias("score"))


@query()
def refine_orientation_projection_center(spark, d):
    seen, moved = _simulated(spark, d)
    out = refinement.refine_orientation_projection_center(seen.withColumns(moved), _SCREEN.with_pc([0.46, 0.71, 0.56]), _BANDS, trust_region=(3, 3, 3, 0.05, 0.05, 0.05))
    return out.select("idx", F.round("score", 3).alias("score"))


def _turned_away(out, truth):
    """Degrees between refined and true rotations."""
    names = [F.col(n).alias(f"true_{n}") for n in "abcd"]
    both = out.join(truth.select(F.col("idx").alias("at"), *names), F.col("idx") == F.col("at"))
    dot = sum((F.col(n) * F.col(f"true_{n}") for n in "bcd"), F.col("a") * F.col("true_a"))
    return both.withColumn("angle", F.degrees(2 * F.acos(F.least(F.abs(dot), F.lit(1.0)))))


@query("SELECT vec_id AS idx, TRUE AS near FROM embeddings")
def refined_orientations_are_near(spark, d):
    """Orientations that start 0.8 degrees off end within 0.6 degrees of those that the patterns were simulated for."""
    seen, moved = _simulated(spark, d)
    out = refinement.refine_orientation(seen.withColumns(moved), _SCREEN, _BANDS, trust_region=(3, 3, 3))
    return _turned_away(out, _quaternions(spark, d)).select("idx", (F.col("angle") < 0.6).alias("near"))


@query("SELECT vec_id AS idx, 0.45::DOUBLE AS pcx, 0.72::DOUBLE AS pcy, 0.55::DOUBLE AS pcz FROM embeddings")
def refined_projection_centres(spark, d):
    """Projection centres that start 0.01 off, to three digits."""
    seen, _ = _simulated(spark, d)
    out = refinement.refine_projection_center(seen, _SCREEN.with_pc([0.46, 0.71, 0.56]), _BANDS, trust_region=(0.05, 0.05, 0.05))
    return out.select("idx", *[F.round(c, 3).alias(c) for c in ("pcx", "pcy", "pcz")])


@query("SELECT vec_id AS idx, TRUE AS near FROM embeddings")
def refined_orientations_and_projection_centres_are_near(spark, d):
    """Both at once: within 0.8 degrees and a hundredth of the detector."""
    seen, moved = _simulated(spark, d)
    out = refinement.refine_orientation_projection_center(seen.withColumns(moved), _SCREEN.with_pc([0.46, 0.71, 0.56]), _BANDS, trust_region=(3, 3, 3, 0.05, 0.05, 0.05))
    off = F.greatest(*[F.abs(F.col(c) - v) for c, v in (("pcx", 0.45), ("pcy", 0.72), ("pcz", 0.55))])
    return _turned_away(out, _quaternions(spark, d)).select("idx", ((F.col("angle") < 0.8) & (off < 0.01)).alias("near"))
