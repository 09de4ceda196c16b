"""Rotations, projections and detector coordinates as column expressions: closed forms that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which a convention of projection centres is known.
CONVENTIONS = {
    "bruker": "bruker", "tsl": "tsl", "edax": "tsl", "ametek": "tsl", "amatek": "tsl", "oxford": "oxford", "aztec": "oxford",
    "emsoft": "emsoft5", "emsoft4": "emsoft4", "emsoft5": "emsoft5",
}


def convention_of(name: str) -> str:
    if name.lower() not in CONVENTIONS:
        raise ValueError(f"unknown projection centre convention {name!r}, it is one of {sorted(CONVENTIONS)}")
    return CONVENTIONS[name.lower()]


def _positive(q: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(F.when(q[0] < 0, -c).otherwise(c) for c in q)


def euler_to_quaternion(phi1: Column, phi: Column, phi2: Column) -> tuple[Column, ...]:
    """Bunge angles (radians) to a quaternion with a scalar part of at least 0."""
    plus, minus = (phi1 + phi2) / 2, (phi1 - phi2) / 2
    return _positive((F.cos(phi / 2) * F.cos(plus), -F.sin(phi / 2) * F.cos(minus), -F.sin(phi / 2) * F.sin(minus), -F.cos(phi / 2) * F.sin(plus)))


def rodrigues_to_quaternion(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """A Rodrigues vector (axis times the tangent of half the angle) to a quaternion; null for the zero vector."""
    norm = F.sqrt(x * x + y * y + z * z)
    sine = F.sin(F.atan(norm))
    return _positive((F.when(norm > 0, F.cos(F.atan(norm))), *[F.when(norm > 0, sine * c / norm) for c in (x, y, z)]))


def rotate_vector(q: tuple[Column, ...], v: tuple[Column, ...]) -> tuple[Column, ...]:
    """v turned by q: v + 2 (a (u x v) + u x (u x v)), where q = (a, u)."""
    a, *u = q
    cross = lambda p, r: (p[1] * r[2] - p[2] * r[1], p[2] * r[0] - p[0] * r[2], p[0] * r[1] - p[1] * r[0])
    once = cross(u, v)
    twice = cross(u, once)
    return tuple(v[k] + (a * once[k] + twice[k]) * 2 for k in range(3))


def rotate_about_axis(v: tuple[Column, ...], axis: tuple[float, float, float], angle: float) -> tuple[Column, ...]:
    n = math.sqrt(sum(c * c for c in axis))
    q = (F.lit(math.cos(angle / 2)), *[F.lit(math.sin(angle / 2) * c / n) for c in axis])
    return rotate_vector(q, v)


def dot(v: tuple[Column, ...], w: tuple[Column, ...]) -> Column:
    return v[0] * w[0] + v[1] * w[1] + v[2] * w[2]


def gnomonic_bounds(shape: tuple[int, int], pcx: Column, pcy: Column, pcz: Column) -> tuple[Column, ...]:
    """x_min, x_max, y_min, y_max of a detector from its projection centre in fractions of it."""
    aspect = shape[1] / shape[0]
    return -pcx / pcz * aspect, (1 - pcx) / pcz * aspect, -(1 - pcy) / pcz, pcy / pcz


def gnomonic_scale(shape: tuple[int, int], bounds: tuple[Column, ...]) -> tuple[Column, Column]:
    """Gnomonic distance between neighbouring pixels, x and y, counted over one less than their number."""
    return (bounds[1] - bounds[0]) / max(1, shape[1] - 1), (bounds[3] - bounds[2]) / max(1, shape[0] - 1)


def pixel_to_gnomonic(shape: tuple[int, int], bounds: tuple[Column, ...], row: Column, col: Column) -> tuple[Column, Column]:
    """(y, x) of a pixel (row, column); here pixels are counted over their whole number."""
    return bounds[3] - row * (bounds[3] - bounds[2]) / shape[0], bounds[0] + col * (bounds[1] - bounds[0]) / shape[1]


def gnomonic_to_pixel(shape: tuple[int, int], bounds: tuple[Column, ...], y: Column, x: Column) -> tuple[Column, Column]:
    return (bounds[3] - y) * shape[0] / (bounds[3] - bounds[2]), (x - bounds[0]) * shape[1] / (bounds[1] - bounds[0])


def pc_to_bruker(convention: str, shape: tuple[int, int], px_size: float, binning: float, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """A projection centre in a convention, as fractions of the detector from its top left corner."""
    rows, cols = shape
    match convention_of(convention):
        case "tsl":
            return x, 1 - y, z * (min(rows, cols) / rows)
        case "oxford":
            return x, 1 - y * (cols / rows), z * (cols / rows)
        case "emsoft4" | "emsoft5" as name:
            x = -x if name == "emsoft4" else x
            return 0.5 - x / (cols * binning), 0.5 - y / (rows * binning), z / (rows * binning * px_size)
    return x, y, z


def pc_from_bruker(convention: str, shape: tuple[int, int], px_size: float, binning: float, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    rows, cols = shape
    match convention_of(convention):
        case "tsl":
            return x, 1 - y, z / (min(rows, cols) / rows)
        case "oxford":
            return x, (1 - y) / (cols / rows), z / (cols / rows)
        case "emsoft4" | "emsoft5" as name:
            side = (0.5 - x) * (cols * binning)
            return -side if name == "emsoft4" else side, (0.5 - y) * (rows * binning), z * (rows * binning * px_size)
    return x, y, z


def crop_pc(shape: tuple[int, int], extent: tuple[int, int, int, int], x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """The projection centre on a detector cropped to (top, bottom, left, right)."""
    (rows, cols), (top, bottom, left, right) = shape, extent
    return (x * cols - left) / (right - left), (y * rows - top) / (bottom - top), z * rows / (bottom - top)


def vector_to_lambert(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Square Lambert coordinates of a vector, each hemisphere on a square of half-width sqrt(pi / 2)."""
    n = F.sqrt(x * x + y * y + z * z)
    radius = F.sqrt(F.greatest(F.lit(0.0), (1 - F.abs(z / n)) * 2))
    bent = lambda major, minor: F.signum(major) * radius * (2 / math.sqrt(math.pi)) * F.atan(minor / major)
    full = lambda major: F.signum(major) * radius * (math.sqrt(math.pi) / 2)
    pole = (x == 0) & (y == 0)
    across = F.abs(y) <= F.abs(x)
    zero = F.lit(0.0)
    return F.when(pole, zero).when(across, full(x)).otherwise(bent(y, x)), F.when(pole, zero).when(across, bent(x, y)).otherwise(full(y))


def lambert_to_vector(x: Column, y: Column) -> tuple[Column, ...]:
    """A vector of the upper hemisphere from square Lambert coordinates in -1..1."""
    x, y = x * math.sqrt(math.pi / 2), y * math.sqrt(math.pi / 2)
    across = F.abs(x) > F.abs(y)
    major, minor = F.when(across, x).otherwise(y), F.when(across, y).otherwise(x)
    turn = F.when(major != 0, minor * (math.pi / 4) / major).otherwise(0.0)
    radius = major * 2 * F.sqrt(math.pi - major * major) / math.pi
    first, second = radius * F.cos(turn), radius * F.sin(turn)
    return F.when(across, first).otherwise(second), F.when(across, second).otherwise(first), 1 - major * major * 2 / math.pi


def direction_cosine(shape: tuple[int, int], pc: tuple[Column, ...], to_detector, row: Column, col: Column) -> tuple[Column, ...]:
    """The unit vector, in the sample frame, from the sample to the middle of a pixel. to_detector: a 3 x 3 matrix."""
    x0, x1, y0, y1 = gnomonic_bounds(shape, *pc)
    x, y = x0 + (x1 - x0) * (col + 0.5) / shape[1], y1 - (y1 - y0) * (row + 0.5) / shape[0]
    n = F.sqrt(x * x + y * y + 1)
    return tuple((x * float(to_detector[0][k]) + y * float(to_detector[1][k]) + float(to_detector[2][k])) / n for k in range(3))


def line_intersection(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, Column]:
    """Where two lines meet, each given by two points (x1, y1, x2, y2); null for parallels."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = p, q
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    some = lambda c: F.when(den != 0, c / den)
    return some(a * (x3 - x4) - b * (x1 - x2)), some(a * (y3 - y4) - b * (y1 - y2))
