"""The detector: its shape and angles, its projection centres, and what follows from them.

A detector has few projection centres (one, or one per calibration pattern) and keeps them as an array. A projection
centre for each point of a large map is a table, and the functions of ``scanloom.functions.geometry`` work on its columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.kernels import geometry as kg


@dataclass(frozen=True)
class Detector:
    """shape in rows and columns, pixel size in micrometres, angles in degrees, ``pc`` (..., 3) in ``convention``; kept
    as fractions of the detector from its top left corner."""

    shape: tuple[int, int] = (1, 1)
    px_size: float = 1.0
    binning: int = 1
    tilt: float = 0.0
    azimuthal: float = 0.0
    twist: float = 0.0
    sample_tilt: float = 70.0
    pc: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.5]))
    convention: str = "bruker"

    def __post_init__(self) -> None:
        pc = np.atleast_2d(np.asarray(self.pc, float))
        if pc.shape[-1] != 3:
            raise ValueError("a projection centre has three coordinates")
        x, y, z = np.moveaxis(pc, -1, 0)
        object.__setattr__(self, "pc", np.stack(np.broadcast_arrays(*geo.pc_to_bruker(self.convention, self.shape, self.px_size, self.binning, x, y, z)), axis=-1))
        object.__setattr__(self, "convention", "bruker")

    # What can be read off.
    nrows = property(lambda self: self.shape[0])
    ncols = property(lambda self: self.shape[1])
    size = property(lambda self: self.shape[0] * self.shape[1])
    height = property(lambda self: self.nrows * self.px_size * self.binning)
    width = property(lambda self: self.ncols * self.px_size * self.binning)
    aspect_ratio = property(lambda self: self.ncols / self.nrows)
    unbinned_shape = property(lambda self: (self.nrows * self.binning, self.ncols * self.binning))
    px_size_binned = property(lambda self: self.px_size * self.binning)
    navigation_shape = property(lambda self: self.pc.shape[:-1])
    navigation_size = property(lambda self: int(np.prod(self.pc.shape[:-1])))
    pcx = property(lambda self: self.pc[..., 0])
    pcy = property(lambda self: self.pc[..., 1])
    pcz = property(lambda self: self.pc[..., 2])
    pc_flattened = property(lambda self: self.pc.reshape(-1, 3))
    pc_average = property(lambda self: np.nanmean(self.pc_flattened, axis=0))
    specimen_scintillator_distance = property(lambda self: self.pcz * self.height)
    euler = property(lambda self: np.array([-self.azimuthal, 90 + self.tilt, -self.twist]))
    bounds = property(lambda self: np.array([0, self.ncols - 1, 0, self.nrows - 1]))
    gnomonic_bounds = property(lambda self: kg.gnomonic_bounds(self.shape, self.pc))
    x_min = property(lambda self: self.gnomonic_bounds[..., 0])
    x_max = property(lambda self: self.gnomonic_bounds[..., 1])
    y_min = property(lambda self: self.gnomonic_bounds[..., 2])
    y_max = property(lambda self: self.gnomonic_bounds[..., 3])
    x_range = property(lambda self: self.gnomonic_bounds[..., :2])
    y_range = property(lambda self: self.gnomonic_bounds[..., 2:])
    x_scale = property(lambda self: (self.x_max - self.x_min) / max(1, self.ncols - 1))
    y_scale = property(lambda self: (self.y_max - self.y_min) / max(1, self.nrows - 1))
    sample_to_detector = property(lambda self: kg.sample_to_detector(self.sample_tilt, self.tilt, self.azimuthal, self.twist))

    @property
    def sample_to_detector_quaternion(self) -> np.ndarray:
        return kg.quaternion_from_matrix(self.sample_to_detector)

    def r_max(self, compat: bool = False) -> np.ndarray:
        """Gnomonic distance of the farthest corner. compat: leave out the lower left corner, as older programs do."""
        x0, x1, y0, y1 = np.moveaxis(self.gnomonic_bounds, -1, 0)
        corners = [x0**2 + y0**2, x1**2 + y0**2, x1**2 + y1**2] + [x0**2 + y1**2] * (not compat)
        return np.sqrt(np.max(corners, axis=0))

    def pc_in(self, convention: str) -> np.ndarray:
        return np.stack(np.broadcast_arrays(*geo.pc_from_bruker(convention, self.shape, self.px_size, self.binning, self.pcx, self.pcy, self.pcz)), axis=-1)

    def pc_bruker(self) -> np.ndarray:
        return self.pc_in("bruker")

    def pc_tsl(self) -> np.ndarray:
        return self.pc_in("tsl")

    def pc_oxford(self) -> np.ndarray:
        return self.pc_in("oxford")

    def pc_emsoft(self, version: int = 5) -> np.ndarray:
        return self.pc_in("emsoft4" if version < 5 else "emsoft5")

    def with_pc(self, pc: np.ndarray, **changes) -> Detector:
        return replace(self, pc=pc, convention="bruker", **changes)

    def crop(self, top: int, bottom: int, left: int, right: int) -> Detector:
        """The part of the detector that an extent, clipped to it, covers."""
        extent = max(top, 0), min(bottom, self.nrows), max(left, 0), min(right, self.ncols)
        if extent[1] <= extent[0] or extent[3] <= extent[2] or any(int(e) != e for e in extent):
            raise ValueError("an extent is four whole numbers with bottom > top and right > left")
        pc = np.stack(geo.crop_pc(self.shape, extent, self.pcx, self.pcy, self.pcz), axis=-1)
        return self.with_pc(pc, shape=(extent[1] - extent[0], extent[3] - extent[2]))

    def downsample(self, factor: int) -> Detector:
        return replace(self, shape=(self.nrows // factor, self.ncols // factor), binning=self.binning * factor)

    def to_gnomonic_coords(self, coords: np.ndarray, pos: int | tuple[int, ...] | None = None) -> np.ndarray:
        """(..., 2) pixels (row, column) to (y, x), for all projection centres or for that of one position."""
        coords, bounds = np.asarray(coords, float), self._bounds_at(pos, np.ndim(coords))
        return np.stack(geo.pixel_to_gnomonic(self.shape, bounds, coords[..., 0], coords[..., 1]), axis=-1)

    def to_pixel_coords(self, coords: np.ndarray, pos: int | tuple[int, ...] | None = None) -> np.ndarray:
        coords, bounds = np.asarray(coords, float), self._bounds_at(pos, np.ndim(coords))
        return np.stack(geo.gnomonic_to_pixel(self.shape, bounds, coords[..., 0], coords[..., 1]), axis=-1)

    def _bounds_at(self, pos, ndim: int) -> tuple[np.ndarray, ...]:
        b = self.gnomonic_bounds
        if pos is not None:
            pos = (pos,) if isinstance(pos, int) else tuple(pos)
            if len(pos) != len(self.navigation_shape):
                raise ValueError(f"a position in a map of shape {self.navigation_shape} has as many numbers")
            b = b[pos]
        elif self.navigation_size == 1:
            b = b.reshape(4)
        else:
            b = b[(..., *[None] * (ndim - 1), slice(None))]
        return tuple(np.moveaxis(b, -1, 0))

    def direction_cosines(self, excluded: np.ndarray | None = None) -> np.ndarray:
        """(pixels, 3), or one such array per projection centre. excluded: pixels to leave out."""
        pc = self.pc_flattened[0] if self.navigation_size == 1 else self.pc_flattened
        return kg.direction_cosines(self.shape, pc, self.sample_to_detector, None if excluded is None else ~np.asarray(excluded, bool).ravel())

    def is_compatible(self, nav_shape: tuple[int, ...], sig_shape: tuple[int, int]) -> bool:
        return tuple(sig_shape) == tuple(self.shape) and (self.navigation_size == 1 or self.navigation_shape == tuple(nav_shape))

    def extrapolate_pc(self, spark: SparkSession, pc_indices: np.ndarray, nav_shape: tuple[int, int], step_sizes: tuple[float, float], shape: tuple[int, int] | None = None, px_size: float | None = None, binning: int | None = None, is_outlier: np.ndarray | None = None) -> DataFrame:
        """(y, x, pcx, pcy, pcz) for each point of a map, on a plane through the mean of this detector's projection centres,
        which belong to the map points pc_indices (2, n). step_sizes: of a map row and column, in micrometres."""
        rows, cols = shape or self.shape
        scale = (self.px_size if px_size is None else px_size) * (self.binning if binning is None else binning)
        inlier = np.ones(self.navigation_size, bool) if is_outlier is None else ~np.asarray(is_outlier, bool).ravel()
        pc = self.pc_flattened[inlier].mean(axis=0)
        row, col = np.round(np.asarray(pc_indices).reshape(2, -1)[:, inlier].mean(axis=1))
        angle = np.deg2rad(90 - self.sample_tilt + self.tilt)
        nx = nav_shape[1]
        grid = spark.range(nav_shape[0] * nx).select(F.floor(F.col("id") / nx).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x"))
        down, across = (F.lit(float(row)) - F.col("y")) * step_sizes[0] / (scale * rows), (F.lit(float(col)) - F.col("x")) * step_sizes[1] / (scale * cols)
        return grid.select("y", "x", (across + float(pc[0])).alias("pcx"), (down * float(np.cos(angle)) + float(pc[1])).alias("pcy"), (float(pc[2]) - down * float(np.sin(angle))).alias("pcz"))

    def pc_table(self, spark: SparkSession) -> DataFrame:
        """(idx, pcx, pcy, pcz) of this detector's projection centres."""
        return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(self.pc_flattened)], "idx bigint, pcx double, pcy double, pcz double")


def convert_pc(df: DataFrame, detector: Detector, from_: str = "bruker", to: str = "bruker") -> DataFrame:
    """pcx, pcy, pcz of a table from one convention to another."""
    bruker = geo.pc_to_bruker(from_, detector.shape, detector.px_size, detector.binning, F.col("pcx"), F.col("pcy"), F.col("pcz"))
    out = geo.pc_from_bruker(to, detector.shape, detector.px_size, detector.binning, *bruker)
    return df.withColumns(dict(zip(("pcx", "pcy", "pcz"), out, strict=True)))
