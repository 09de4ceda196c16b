"""Rotations, projections and simulated patterns, for arrays of quaternions (n, 4) and of vectors (..., 3)."""

from __future__ import annotations

import numpy as np


def quaternion_from_euler(euler: np.ndarray) -> np.ndarray:
    """Bunge angles (radians) to unit quaternions with a scalar part of at least 0."""
    a, b, c = np.moveaxis(np.asarray(euler, float), -1, 0)
    plus, minus = (a + c) / 2, (a - c) / 2
    cos, sin = np.cos(b / 2), np.sin(b / 2)
    q = np.stack([cos * np.cos(plus), -sin * np.cos(minus), -sin * np.sin(minus), -cos * np.sin(plus)], axis=-1)
    return np.where(q[..., :1] < 0, -q, q)


def euler_from_quaternion(q: np.ndarray) -> np.ndarray:
    """Bunge angles in [0, 2 pi), [0, pi], [0, 2 pi); where the first and last axes agree, the last angle is 0."""
    q = np.asarray(q, float)
    a, b, c, d = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    ad, bc = a * a + d * d, b * b + c * c
    chi = np.sqrt(ad * bc)
    plus, minus = np.arctan2(-d, a), np.arctan2(-c, -b)
    phi1 = np.where(chi > 1e-12, plus + minus, np.where(bc <= 1e-12, 2 * plus, 2 * minus))
    phi2 = np.where(chi > 1e-12, plus - minus, 0.0)
    return np.stack([np.mod(phi1, 2 * np.pi), 2 * np.arctan2(np.sqrt(bc), np.sqrt(ad)), np.mod(phi2, 2 * np.pi)], axis=-1)


def matrix(q: np.ndarray) -> np.ndarray:
    """(..., 3, 3) matrices M with M @ v the vector v turned by the quaternion."""
    a, b, c, d = np.moveaxis(np.asarray(q, float), -1, 0)
    rows = [
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a - b * b + c * c - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a - b * b - c * c + d * d],
    ]
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=-2)


def quaternion_from_matrix(m: np.ndarray) -> np.ndarray:
    """The quaternion of one rotation matrix, with a scalar part of at least 0."""
    k = np.array([
        [m[0, 0] + m[1, 1] + m[2, 2], 0, 0, 0],
        [m[2, 1] - m[1, 2], m[0, 0] - m[1, 1] - m[2, 2], 0, 0],
        [m[0, 2] - m[2, 0], m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], 0],
        [m[1, 0] - m[0, 1], m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1]],
    ])
    _, vectors = np.linalg.eigh(k / 3, UPLO="L")
    q = vectors[:, -1]
    return -q if q[0] < 0 else q


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    a, b, c, d = np.moveaxis(np.asarray(p, float), -1, 0)
    e, f, g, h = np.moveaxis(np.asarray(q, float), -1, 0)
    out = np.stack([a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e], axis=-1)
    return np.where(out[..., :1] < 0, -out, out)


def misorientation_angle(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Angle (radians) between rotations, without symmetry."""
    return 2 * np.arccos(np.clip(np.abs((np.asarray(p) * np.asarray(q)).sum(-1)), 0, 1))


def turn_about(vectors: np.ndarray, axis: np.ndarray, angle: float) -> np.ndarray:
    """Vectors turned about an axis by an angle (radians)."""
    u = np.asarray(axis, float) / np.linalg.norm(axis)
    half = np.concatenate([[np.cos(angle / 2)], np.sin(angle / 2) * u])
    return vectors @ matrix(half).T


def sample_to_detector(sample_tilt: float, tilt: float, azimuthal: float, twist: float) -> np.ndarray:
    """The matrix that takes vectors of the sample frame to the detector frame; angles in degrees.

    Its rows are the detector's axes in the sample frame. They start as (Y, Z, X) of the sample. Then the whole frame turns
    about its own first axis by the sample's tilt backwards and the detector's tilt, about its second by the azimuthal
    angle backwards, and about its third by the twist backwards.
    """
    frame = np.eye(3)[[1, 2, 0]]
    for axis, angle in ((0, -sample_tilt), (0, tilt), (1, -azimuthal), (2, -twist)):
        frame = turn_about(frame, frame[axis], np.deg2rad(angle))
    return frame


def gnomonic_bounds(shape: tuple[int, int], pc: np.ndarray) -> np.ndarray:
    """(..., 4): least and greatest x, least and greatest y, from projection centres (..., 3) in fractions of the detector."""
    x, y, z = np.moveaxis(np.asarray(pc, float), -1, 0)
    aspect = shape[1] / shape[0]
    return np.stack([-aspect * x / z, aspect * (1 - x) / z, -(1 - y) / z, y / z], axis=-1)


def direction_cosines(shape: tuple[int, int], pc: np.ndarray, to_detector: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors (..., pixels, 3) from the sample to the middle of each detector pixel, in the sample frame."""
    rows, cols = shape
    x0, x1, y0, y1 = (b[..., None] for b in np.moveaxis(gnomonic_bounds(shape, pc), -1, 0))
    at = np.arange(rows * cols) if kept is None else np.flatnonzero(kept)
    x = x0 + (x1 - x0) * (at % cols + 0.5) / cols
    y = y1 - (y1 - y0) * (at // cols + 0.5) / rows
    v = np.stack([x, y, np.ones_like(x)], axis=-1)
    return (v / np.linalg.norm(v, axis=-1, keepdims=True)) @ to_detector


def vector_to_lambert(v: np.ndarray) -> np.ndarray:
    """Square Lambert coordinates (..., 2) of vectors, each hemisphere on a square of half-width sqrt(pi / 2)."""
    x, y, z = np.moveaxis(v / np.linalg.norm(v, axis=-1, keepdims=True), -1, 0)
    across = np.abs(y) <= np.abs(x)
    major, minor = np.where(across, x, y), np.where(across, y, x)
    radius = np.sign(major) * np.sqrt(np.maximum(0, 2 * (1 - np.abs(z))))
    with np.errstate(invalid="ignore", divide="ignore"):
        bend = np.where(major != 0, np.arctan(minor / np.where(major == 0, 1, major)), 0)
    first, second = radius * np.sqrt(np.pi) / 2, radius * 2 / np.sqrt(np.pi) * bend
    return np.stack([np.where(across, first, second), np.where(across, second, first)], axis=-1)


def lambert_to_vector(xy: np.ndarray) -> np.ndarray:
    """Vectors of the upper hemisphere from square Lambert coordinates in -1..1."""
    x, y = np.moveaxis(np.asarray(xy, float) * np.sqrt(np.pi / 2), -1, 0)
    across = np.abs(x) > np.abs(y)
    major, minor = np.where(across, x, y), np.where(across, y, x)
    radius = 2 * major * np.sqrt(np.maximum(0, np.pi - major**2)) / np.pi
    turn = np.where(major != 0, minor * np.pi / 4 / np.where(major == 0, 1, major), 0)
    first, second = radius * np.cos(turn), radius * np.sin(turn)
    return np.stack([np.where(across, first, second), np.where(across, second, first), 1 - 2 * major**2 / np.pi], axis=-1)


def lookup(master: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Intensities at vectors (..., 3) in a Lambert master pattern (2, n, n), upper and lower half, by bilinear interpolation."""
    return _intensities(master, *np.ascontiguousarray(v.reshape(-1, 3).T)).reshape(v.shape[:-1])


def _intensities(master: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """``lookup`` of vectors by coordinate. They needn't be unit vectors; ``length`` is theirs. Coordinates are those of
    ``vector_to_lambert`` in pixels of the master pattern, and arrays are used again: most of the time goes into memory."""
    n = master.shape[1]
    half = (n - 1) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        radius = np.abs(z)
        radius /= np.sqrt(x * x + y * y + z * z) if length is None else length
        np.subtract(1, radius, out=radius)
        np.maximum(radius, 0, out=radius)
        np.sqrt(radius, out=radius)  # the square roots of 2 and pi are in the factors
        minor, other = np.abs(x), np.abs(y)
        across = other <= minor
        major = np.maximum(minor, other)
        np.minimum(minor, other, out=minor)
        minor /= np.maximum(major, 1e-300, out=major)
    np.arctan(minor, out=minor)
    minor *= radius
    minor *= half * 4 / np.pi
    radius *= half
    col, row = np.where(across, radius, minor), np.where(across, minor, radius)
    np.copysign(col, x, out=col)
    np.copysign(row, y, out=row)
    col += half
    row += half
    last = max(n - 2, 0)
    with np.errstate(invalid="ignore"):
        r0, c0 = np.clip(row.astype(np.int64), 0, last), np.clip(col.astype(np.int64), 0, last)
    row -= r0
    col -= c0
    flat = master.reshape(-1)
    at = r0 * n
    at += c0
    at += (z < 0) * (n * n)
    right, down = (1, n) if n > 1 else (0, 0)
    top, bottom = flat.take(at), flat.take(at + down)
    top += col * (flat.take(at + right) - top)
    bottom += col * (flat.take(at + (down + right)) - bottom)
    bottom -= top
    bottom *= row
    top += bottom
    return top


def project(master: np.ndarray, q: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Patterns (n, pixels): the master pattern seen along ``cosines``, (pixels, 3) or (n, pixels, 3), from crystals with
    rotations q (n, 4)."""
    v = matrix(q) @ np.swapaxes(cosines, -1, -2)
    return _intensities(master, *(v[..., k, :] for k in range(3)))


def project_from(master: np.ndarray, q: np.ndarray, shape: tuple[int, int], pc: np.ndarray, to_detector: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """``project`` along the ``direction_cosines`` of projection centres pc (n, 3), one for each rotation. They aren't made:
    turned, they are a sum of what a pixel's column and its row give."""
    rows, cols = shape
    x0, x1, y0, y1 = (b[..., None] for b in np.moveaxis(gnomonic_bounds(shape, pc), -1, 0))
    x = x0 + (x1 - x0) * (np.arange(cols) + 0.5) / cols
    y = y1 - (y1 - y0) * (np.arange(rows) + 0.5) / rows
    turn = to_detector @ np.swapaxes(matrix(q), -1, -2)
    flat = lambda v: v.reshape(len(v), -1) if kept is None else v.reshape(len(v), -1)[:, kept]
    parts = [flat((y * turn[:, 1, k, None])[:, :, None] + (x * turn[:, 0, k, None] + turn[:, 2, k, None])[:, None, :]) for k in range(3)]
    length = flat(np.sqrt((y * y + 1)[:, :, None] + (x * x)[:, None, :]))
    return _intensities(master, *parts, length)


def stereographic_to_vector(x: np.ndarray, y: np.ndarray, pole: int = -1) -> np.ndarray:
    """Unit vectors of points of the plane, seen from the pole: -1 gives the upper hemisphere, 1 the lower."""
    s = 1 + x * x + y * y
    return np.stack([2 * x / s, 2 * y / s, -pole * (1 - x * x - y * y) / s], axis=-1)


def vector_to_stereographic(v: np.ndarray) -> np.ndarray:
    z = 1 + np.abs(v[..., 2])
    return np.stack([v[..., 0] / z, v[..., 1] / z], axis=-1)
