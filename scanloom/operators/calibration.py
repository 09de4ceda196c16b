"""Calibration of projection centres: planes fitted to many of them, tilts, and the moving-screen method.

What a fit needs are sums over the table (one small row), so a table of any size can be fitted; only robust and projective
fits, which look at each projection centre again and again, take an array of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.kernels import geometry as kg

PC = ("pcx", "pcy", "pcz")


def estimate_xtilt(pcs: DataFrame, degrees: bool = False) -> DataFrame:
    """One row with ``x_tilt``: 90 degrees and the inclination of the line of pcy over pcz."""
    slope = F.regr_slope("pcy", "pcz")
    angle = F.atan(slope) + math.pi / 2
    return pcs.agg((F.degrees(angle) if degrees else angle).alias("x_tilt"))


def estimate_xtilt_robust(pc: np.ndarray, residual: float | None = None, trials: int = 200, seed: int = 0) -> tuple[float, np.ndarray]:
    """(x tilt in radians, outliers): the line through two random points that most points are near, then fitted to those.
    A point is near within the median absolute deviation of pcy, unless ``residual`` is given."""
    y, z = pc[:, 1], pc[:, 2]
    residual = np.median(np.abs(y - np.median(y))) if residual is None else residual
    rng, best = np.random.default_rng(seed), np.zeros(len(y), bool)
    for _ in range(trials):
        i, j = rng.choice(len(y), 2, replace=False)
        if z[i] == z[j]:
            continue
        slope = (y[j] - y[i]) / (z[j] - z[i])
        near = np.abs(y - y[i] - slope * (z - z[i])) <= residual
        if near.sum() > best.sum():
            best = near
    slope = np.polyfit(z[best], y[best], 1)[0]
    return float(np.pi / 2 + np.arctan(slope)), ~best


def plane_of(pc: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(x tilt, z tilt, mean) in radians of the plane nearest to points, which goes through their mean: tilts of its normal
    about the detector's x and z axes. Through another middle, as one without the outermost tenths, it would be tilted off
    points that lie on a plane, where they aren't evenly spread about it."""
    middle = pc.mean(axis=0)
    normal = np.linalg.svd(pc - middle, full_matrices=False)[2][2]
    normal = -normal if normal[2] < 0 else normal
    return float(np.arccos(np.clip(normal[2], -1, 1))), float(np.pi / 2 - np.arctan2(normal[1], normal[0])), middle


def estimate_xtilt_ztilt(pc: np.ndarray, degrees: bool = False, is_outlier: np.ndarray | None = None) -> tuple[float, float]:
    pc = np.asarray(pc, float).reshape(-1, 3)
    pc = pc if is_outlier is None else pc[~np.asarray(is_outlier, bool).ravel()]
    if len(pc) < 2:
        raise ValueError("tilts need several projection centres")
    tilts = plane_of(pc - pc.mean(axis=0))[:2]
    return tuple(np.rad2deg(tilts)) if degrees else tilts


def fit_pc_affine(pcs: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """One row per coordinate (pc): row, col, const of the least-squares plane pc = row * y + col * x + const.

    From sums over the table in one pass: the normal equations of the centred problem.
    """
    c = {"y": F.col(y).cast("double"), "x": F.col(x).cast("double"), **{p: F.col(p) for p in PC}}
    means = pcs.agg(*[F.avg(v).alias(f"m_{k}") for k, v in c.items()])
    pairs = [("y", "y"), ("x", "x"), ("y", "x"), *[(a, p) for p in PC for a in ("y", "x")]]
    centred = pcs.join(F.broadcast(means))
    part = lambda k: c[k] - F.col(f"m_{k}")
    sums = centred.agg(*[F.first(f"m_{k}").alias(f"m_{k}") for k in c], *[F.sum(part(a) * part(b)).alias(f"{a}_{b}") for a, b in pairs])
    det = F.col("y_y") * F.col("x_x") - F.col("y_x") * F.col("y_x")

    def solved(p: str):
        row = (F.col(f"y_{p}") * F.col("x_x") - F.col(f"x_{p}") * F.col("y_x")) / det
        col = (F.col(f"x_{p}") * F.col("y_y") - F.col(f"y_{p}") * F.col("y_x")) / det
        return F.struct(F.lit(p).alias("pc"), row.alias("row"), col.alias("col"), (F.col(f"m_{p}") - row * F.col("m_y") - col * F.col("m_x")).alias("const"))

    return sums.select(F.inline(F.array(*[solved(p) for p in PC])))


def apply_pc_fit(points: DataFrame, fit: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """``points`` with pcx, pcy, pcz on the fitted planes."""
    wide = fit.groupBy().agg(*[F.first(F.when(F.col("pc") == p, F.col(k)), ignorenulls=True).alias(f"_{p}_{k}") for p in PC for k in ("row", "col", "const")])
    out = points.join(F.broadcast(wide))
    return out.select(*points.columns, *[(F.col(f"_{p}_row") * F.col(y) + F.col(f"_{p}_col") * F.col(x) + F.col(f"_{p}_const")).alias(p) for p in PC])


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix H with dst ~ H src for points (n, 2), n >= 4: least squares on points moved to their middle and
    scaled to a mean distance of sqrt(2)."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = p.mean(axis=0)
        s = np.sqrt(2) / max(np.linalg.norm(p - middle, axis=1).mean(), 1e-300)
        return (p - middle) * s, np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])

    (a, ta), (b, tb) = scaled(np.asarray(src, float)), scaled(np.asarray(dst, float))
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    left = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([left, zero, -b[:, :1] * left]), np.hstack([zero, left, -b[:, 1:] * left])])
    # of the triangle that n points come down to: as many rows as unknowns, whatever n
    h = np.linalg.svd(np.linalg.qr(rows, mode="r"))[2][-1].reshape(3, 3)
    out = np.linalg.inv(tb) @ h @ ta
    return out / out[2, 2]


def fit_pc_projective(pc: np.ndarray, pc_indices: np.ndarray, map_indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fit, fit for the map): projection centres (n, 3) at map points (n, 2), laid into the plane nearest to them, where a
    homography takes map points to their places; for those points and for map_indices (m, 2)."""
    mean = pc.mean(axis=0)
    x_tilt, z_tilt, middle = plane_of(pc - mean)
    about = lambda axis, angle: kg.matrix(np.array([np.cos(angle / 2), *(np.sin(angle / 2) * np.array(axis))]))
    lift = about([0, 0, 1], -z_tilt) @ about([1, 0, 0], -x_tilt)
    flat = (pc - mean - middle) @ lift
    h = homography(pc_indices, flat[:, :2])

    def placed(points: np.ndarray) -> np.ndarray:
        at = np.column_stack([points, np.ones(len(points))]) @ h.T
        at = np.column_stack([at[:, :2] / at[:, 2:], np.zeros(len(at))])
        return at @ lift.T + middle + mean

    return placed(np.asarray(pc_indices, float)), placed(np.asarray(map_indices, float))


def fit_pc(pc: np.ndarray, pc_indices: np.ndarray, map_indices: np.ndarray, transformation: str = "projective", is_outlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(fit, fit for the map, x tilt in degrees) of projection centres at pc_indices (2, ...) for all map_indices (2, ny, nx)."""
    pc, at = np.asarray(pc, float).reshape(-1, 3), np.asarray(pc_indices, float).reshape(2, -1).T
    to = np.asarray(map_indices, float)
    if is_outlier is not None:
        pc, at = pc[~np.asarray(is_outlier, bool).ravel()], at[~np.asarray(is_outlier, bool).ravel()]
    flat = to.reshape(2, -1).T
    if transformation == "projective":
        fit, fit_map = fit_pc_projective(pc, at, flat)
    elif transformation == "affine":
        with_one = lambda p: np.column_stack([p, np.ones(len(p))])
        coefficients = np.linalg.lstsq(with_one(at), pc, rcond=None)[0]
        fit, fit_map = with_one(at) @ coefficients, with_one(flat) @ coefficients
    else:
        raise ValueError(f"unknown transformation {transformation!r}, it is 'projective' or 'affine'")
    slope = np.polyfit(fit[:, 2], fit[:, 1], 1)[0]
    return fit, fit_map.reshape(*to.shape[1:], 3), float(np.rad2deg(np.pi / 2 + np.arctan(slope)))


def moving_screen(points: DataFrame, shape: tuple[int, int], delta_z: float = 1.0, px_size: float | None = None, binning: int = 1, convention: str = "tsl") -> DataFrame:
    """Estimates (i, j, pcx, pcy, pcz) from each pair of corresponding points (k, x_in, y_in, x_out, y_out) of a pattern
    with the screen in and one with it ``delta_z`` further out.

    The lines through corresponding points meet in the projection centre; estimates outside the detector don't count. pcz is
    in the unit of delta_z, or with px_size a fraction of the detector's height.
    """
    rows, cols = shape
    a = points.select(F.col("k").alias("i"), *[F.col(c).cast("double").alias(f"a_{c}") for c in ("x_in", "y_in", "x_out", "y_out")])
    b = points.select(F.col("k").alias("j"), *[F.col(c).cast("double").alias(f"b_{c}") for c in ("x_in", "y_in", "x_out", "y_out")])
    pairs = a.join(b, F.col("i") < F.col("j"))
    line = lambda n: tuple(F.col(f"{n}_{c}") for c in ("x_out", "y_out", "x_in", "y_in"))
    x, y = geo.line_intersection(line("a"), line("b"))
    length = lambda s: F.sqrt(F.pow(F.col(f"a_x_{s}") - F.col(f"b_x_{s}"), 2) + F.pow(F.col(f"a_y_{s}") - F.col(f"b_y_{s}"), 2))
    z = F.lit(float(delta_z)) / (length("out") / length("in") - 1)
    z = z if px_size is None else z / (rows * px_size * binning)
    inside = pairs.select("i", "j", x.alias("px"), y.alias("py"), z.alias("pcz")).filter((F.col("px") > 0) & (F.col("px") < cols) & (F.col("py") > 0) & (F.col("py") < rows))
    pcy = F.col("py") / rows
    return inside.select("i", "j", (F.col("px") / cols).alias("pcx"), (1 - pcy if convention == "tsl" else pcy).alias("pcy"), "pcz")


def moving_screen_pc(estimates: DataFrame) -> DataFrame:
    return estimates.agg(*[F.avg(p).alias(p) for p in PC])


def points_table(spark: SparkSession, points_in: list[tuple[float, float]], points_out: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(points_in, points_out, strict=True))], "k int, x_in double, y_in double, x_out double, y_out double")
