"""Kinematical master patterns, and the bands and zone axes that a detector sees.

Reflectors are few (hundreds), so they are an array literal that each row is exploded with: rotations times reflectors come
out of one projection, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.operators.detector import Detector


def reciprocal_basis(lattice: tuple[float, float, float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(direct, reciprocal) bases as rows, of a lattice a, b, c, alpha, beta, gamma (degrees). The reciprocal c axis is
    along z, the direct a axis in the xz plane."""
    a, b, c, *angles = lattice
    ca, cb, cg = np.cos(np.deg2rad(angles))
    sa, sb, _ = np.sin(np.deg2rad(angles))
    cgs = (ca * cb - cg) / (sa * sb)  # cosine of the reciprocal gamma
    direct = np.array([[a * sb, 0, a * cb], [-b * sa * cgs, b * sa * math.sqrt(max(0.0, 1 - cgs * cgs)), b * ca], [0, 0, c]])
    return direct, np.linalg.inv(direct).T


@dataclass(frozen=True)
class Reflectors:
    """hkl (n, 3) of a lattice, with structure factors and Bragg angles (radians) where those are needed."""

    hkl: np.ndarray
    lattice: tuple[float, float, float, float, float, float] = (1, 1, 1, 90, 90, 90)
    structure_factor: np.ndarray | None = None
    theta: np.ndarray | None = None

    @property
    def vectors(self) -> np.ndarray:
        """Unit normals in the crystal's frame."""
        v = np.asarray(self.hkl, float) @ reciprocal_basis(self.lattice)[1]
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def with_theta(self, wavelength: float) -> Reflectors:
        """Bragg angles for a wavelength in the unit of the lattice."""
        length = np.linalg.norm(np.asarray(self.hkl, float) @ reciprocal_basis(self.lattice)[1], axis=1)
        return Reflectors(self.hkl, self.lattice, self.structure_factor, np.arcsin(np.clip(wavelength * length / 2, -1, 1)))

    def intensities(self, scaling: str | None) -> np.ndarray:
        if scaling is None:
            return np.ones(len(self.hkl))
        if scaling not in ("linear", "square"):
            raise ValueError(f"unknown scaling {scaling!r}, it is 'linear', 'square' or None")
        if self.structure_factor is None:
            raise ValueError("scaled intensities need structure factors")
        f = np.abs(self.structure_factor)
        return f if scaling == "linear" else f**2


def kinematical_master(spark: SparkSession, reflectors: Reflectors, half_size: int = 500, hemisphere: str = "upper", scaling: str | None = "linear") -> DataFrame:
    """(hemisphere, r, c, intensity) of a stereographic master pattern of 2 * half_size + 1 pixels a side.

    A reflector adds its intensity where the angle to its normal is 90 degrees at most and at least 90 less its Bragg angle,
    and half of it where the angle is exactly 90. Pixels are rows made by the executors, and reflectors are a literal.
    """
    if reflectors.theta is None:
        raise ValueError("a master pattern needs Bragg angles, see with_theta()")
    poles = {"upper": [-1], "lower": [1], "both": [-1, 1]}[hemisphere]
    n = 2 * half_size + 1
    bands = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("nx", "ny", "nz", "i", "least"), (*vector, i, math.pi / 2 - t), strict=True)]) for vector, i, t in zip(reflectors.vectors, reflectors.intensities(scaling), reflectors.theta, strict=True)])
    x, y = ((F.col(k) - half_size) / float(half_size) for k in ("c", "r"))
    s = 1 + x * x + y * y
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    grid = grid.select("r", "c", F.explode(F.array(*[F.lit(p) for p in poles])).alias("pole"))
    at = grid.select("r", "c", "pole", F.struct((2 * x / s).alias("x"), (2 * y / s).alias("y"), (-F.col("pole") * (1 - x * x - y * y) / s).alias("z")).alias("v"))

    def added(b: Column) -> Column:
        d = b["nx"] * F.col("v.x") + b["ny"] * F.col("v.y") + b["nz"] * F.col("v.z")
        angle = F.acos(F.greatest(F.least(d, F.lit(1.0)), F.lit(-1.0)))
        return F.when(F.abs(d) <= 1e-7, b["i"] * 0.5).when((angle <= math.pi / 2) & (angle >= b["least"]), b["i"]).otherwise(0.0)

    return at.select(F.when(F.col("pole") == -1, "upper").otherwise("lower").alias("hemisphere"), "r", "c", F.aggregate(bands, F.lit(0.0), lambda a, b: a + added(b)).alias("intensity"))


def zone_axes_of(hkl: np.ndarray) -> np.ndarray:
    """Distinct cross products of all pairs of reflectors but zero, over their greatest common divisor."""
    hkl = np.asarray(hkl).astype(int)
    uvw = np.cross(hkl[:, None], hkl[None]).reshape(-1, 3)
    uvw = uvw[(uvw != 0).any(axis=1)]
    return np.unique(uvw // np.gcd.reduce(uvw, axis=1)[:, None], axis=0)


def _on_detector(rotations: DataFrame, vectors: np.ndarray, names: tuple[str, str, str], integers: np.ndarray, detector: Detector) -> DataFrame:
    """rotations x vectors with dx, dy, dz, the vector on the detector. vectors are in the crystal's frame."""
    m = detector.sample_to_detector
    rows = F.array(*[F.struct(*[F.lit(int(k)).alias(n) for n, k in zip(names, hkl, strict=True)], *[F.lit(float(c)).alias(n) for n, c in zip(("vx", "vy", "vz"), v, strict=True)]) for hkl, v in zip(integers, vectors, strict=True)])
    keys = [c for c in rotations.columns if c not in "abcd"]
    each = rotations.select(*keys, *"abcd", F.inline(rows))
    # the crystal's vector in the sample: turned back by the orientation
    q = (F.col("a"), -F.col("b"), -F.col("c"), -F.col("d"))
    s = geo.rotate_vector(q, (F.col("vx"), F.col("vy"), F.col("vz")))
    d = [sum((s[k] * float(m[r][k]) for k in (1, 2)), s[0] * float(m[r][0])) for r in range(3)]
    return each.select(*keys, *names, d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz"))


def bands_on_detector(rotations: DataFrame, reflectors: Reflectors, detector: Detector, max_r: float | None = None) -> DataFrame:
    """One row per rotation and band that it shows: the keys, h, k, l, hesse, and the gnomonic ends x0, y0, x1, y1 of the
    band's centre line on the circle of radius ``max_r`` (by default to the detector's farthest corner).

    A band whose normal points away from the detector is shown by its opposite; a line outside the circle isn't shown.
    """
    r = float(np.max(detector.r_max())) if max_r is None else float(max_r)
    at = _on_detector(rotations, reflectors.vectors, ("h", "k", "l"), reflectors.hkl, detector)
    keys = [c for c in rotations.columns if c not in "abcd"]
    flat = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    shown = at.filter("dz > 0").withColumn("hesse", F.when(flat > 0, F.col("dz") / flat)).filter(F.abs("hesse") < r)
    turn, open_ = F.atan2("dy", "dx") - math.pi, F.acos(F.col("hesse") / r)
    ends = [(F.cos(turn + open_) * r).alias("x0"), (F.sin(turn + open_) * r).alias("y0"), (F.cos(turn - open_) * r).alias("x1"), (F.sin(turn - open_) * r).alias("y1")]
    return shown.select(*keys, "h", "k", "l", "hesse", *ends)


def zone_axes_on_detector(rotations: DataFrame, reflectors: Reflectors, detector: Detector, max_r: float | None = None) -> DataFrame:
    """One row per rotation and zone axis that it shows: the keys, u, v, w, and gnomonic x, y, within the detector and one
    pixel around it and within ``max_r``."""
    r = float(np.max(detector.r_max())) if max_r is None else float(max_r)
    uvw = zone_axes_of(reflectors.hkl)
    at = _on_detector(rotations, uvw @ reciprocal_basis(reflectors.lattice)[0], ("u", "v", "w"), uvw, detector)
    keys = [c for c in rotations.columns if c not in "abcd"]
    x, y = F.col("dx") / F.col("dz"), F.col("dy") / F.col("dz")
    (x0, x1), (y0, y1) = detector.x_range.reshape(-1, 2)[0], detector.y_range.reshape(-1, 2)[0]
    sx, sy = float(np.ravel(detector.x_scale)[0]), float(np.ravel(detector.y_scale)[0])
    seen = at.filter("dz > 0").select(*keys, "u", "v", "w", x.alias("x"), y.alias("y"))
    return seen.filter(F.col("x").between(float(x0) - sx, float(x1) + sx) & F.col("y").between(float(y0) - sy, float(y1) + sy) & (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < r))


def to_pixels(df: DataFrame, detector: Detector, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Gnomonic coordinates (x, y) in pairs of columns as pixel coordinates (column, row)."""
    bounds = tuple(F.lit(float(b)) for b in detector.gnomonic_bounds.reshape(-1, 4)[0])
    out = df
    for x, y in pairs:
        row, col = geo.gnomonic_to_pixel(detector.shape, bounds, F.col(y), F.col(x))
        out = out.withColumns({x: col, y: row})
    return out
