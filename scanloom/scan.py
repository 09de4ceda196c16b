"""A scan: a table of patterns with what belongs to it, and the operators as methods.

Scans never change; each method gives a new one, and what belongs to the scan (detector, background, crystal map, steps)
follows the patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scanloom.functions import pixels as px
from scanloom.functions.windows import Window
from scanloom.kernels.blocks import map_patterns
from scanloom.operators import decomposition, frequency, indexing, intensity, neighbours, refinement, selection
from scanloom.operators.detector import Detector
from scanloom.operators.master_pattern import MasterPattern
from scanloom.operators.virtual_imaging import VirtualImager, virtual_image


@dataclass(frozen=True)
class Scan:
    """df: idx, y, x, pixels (row-major, of ``shape``); dtype: of the intensities, for ranges and casts."""

    df: DataFrame
    shape: tuple[int, int]
    dtype: str = "float64"
    nav_shape: tuple[int, int] | None = None
    detector: Detector | None = None
    static_background: np.ndarray | None = None
    xmap: DataFrame | None = None
    step: tuple[float, float] = (1.0, 1.0)
    unit: str = "px"
    metadata: dict = field(default_factory=dict)

    @property
    def n_pixels(self) -> int:
        return self.shape[0] * self.shape[1]

    def _with(self, df: DataFrame, **changes) -> Scan:
        return replace(self, df=df, **changes)

    def _cast(self, dtype_out: str | None) -> str:
        return dtype_out or self.dtype

    def map_shape(self) -> tuple[int, int]:
        """(ny, nx), looked up if it isn't known."""
        if self.nav_shape is not None:
            return self.nav_shape
        top = self.df.agg(F.max("y") + 1, F.max("x") + 1).first()
        return int(top[0]), int(top[1])

    # Intensities
    def rescale_intensity(self, relative: bool = False, in_range=None, out_range=None, dtype_out: str | None = None, percentiles=None) -> Scan:
        to = self._cast(dtype_out)
        return self._with(intensity.rescale_intensity(self.df, relative, in_range, out_range, to, percentiles), dtype=to)

    def normalize_intensity(self, num_std: float = 1, divide_by_square_root: bool = False, dtype_out: str | None = None) -> Scan:
        to = self._cast(dtype_out)
        return self._with(intensity.normalize_intensity(self.df, num_std, divide_by_square_root, to), dtype=to)

    def remove_static_background(self, operation: str = "subtract", static_bg=None, scale_bg: bool = False) -> Scan:
        background = self.static_background if static_bg is None else static_bg
        if background is None:
            raise ValueError("the scan has no static background, and none was given")
        return self._with(intensity.remove_static_background(self.df, background, operation, scale_bg, self.dtype))

    def remove_dynamic_background(self, operation: str = "subtract", filter_domain: str = "frequency", std: float | None = None, truncate: float = 4.0) -> Scan:
        return self._with(intensity.remove_dynamic_background(self.df, self.shape, operation, filter_domain, std, truncate, self.dtype))

    def get_dynamic_background(self, filter_domain: str = "frequency", std: float | None = None, truncate: float = 4.0, dtype_out: str | None = None) -> Scan:
        out = intensity.dynamic_background(self.df, self.shape, filter_domain, std, truncate)
        to = self._cast(dtype_out)
        return self._with(intensity.change_dtype(out, to), dtype=to)

    def downsample(self, factor: int, dtype_out: str | None = None) -> Scan:
        to = self._cast(dtype_out)
        background = self.static_background
        if background is not None:
            r, c = self.shape[0] // factor, self.shape[1] // factor
            background = np.asarray(background, float).reshape(r, factor, c, factor).sum(axis=(1, 3))
        return self._with(intensity.downsample(self.df, self.shape, factor, to), shape=(self.shape[0] // factor, self.shape[1] // factor), dtype=to, detector=self.detector and self.detector.downsample(factor), static_background=background)

    def adaptive_histogram_equalization(self, kernel_size=None, clip_limit: float = 0.0, nbins: int = 128) -> Scan:
        return self._with(intensity.adaptive_histogram_equalization(self.df, self.shape, kernel_size, clip_limit, nbins, self.dtype))

    def change_dtype(self, dtype: str) -> Scan:
        return self._with(intensity.change_dtype(self.df, dtype), dtype=dtype)

    def add_ramp(self, ramp_x: float, ramp_y: float, offset: float = 0.0) -> Scan:
        return self._with(intensity.add_ramp(self.df, self.shape, ramp_x, ramp_y, offset), dtype="float64")

    def add_gaussian_noise(self, std: float, seed: int = 0) -> Scan:
        return self._with(intensity.add_noise(self.df, self.shape, "gaussian", std, seed), dtype="float64")

    def add_poissonian_noise(self, seed: int = 0) -> Scan:
        return self._with(intensity.add_noise(self.df, self.shape, "poisson", seed=seed), dtype="float64")

    def map(self, function: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int] | None = None) -> Scan:
        """``function`` of blocks (n, rows, columns) gives blocks of patterns, of another shape if it is said."""
        out = StructType([StructField("pixels", ArrayType(DoubleType()))])
        own = self.shape  # not self: a table can't go to the tasks
        made = map_patterns(self.df, lambda b: {"pixels": np.asarray(function(b.reshape(-1, *own)), float).reshape(len(b), -1)}, out, self.n_pixels)
        return self._with(made, shape=shape or self.shape, dtype="float64")

    # Frequency domain
    def fft(self, apodization: np.ndarray | None = None, shift: bool = False) -> DataFrame:
        return frequency.fft(self.df, self.shape, apodization, shift)

    def fft_filter(self, transfer_function, function_domain: str = "frequency", shift: bool = False) -> Scan:
        return self._with(frequency.fft_filter(self.df, self.shape, transfer_function, function_domain, shift, dtype_out=self.dtype))

    def get_image_quality(self, normalize: bool = True) -> DataFrame:
        return frequency.image_quality(self.df, self.shape, normalize).drop("pixels")

    # Neighbourhoods
    def average_neighbour_patterns(self, window: Window | str = "circular", window_shape: tuple[int, ...] = (3, 3), **parameters) -> Scan:
        w = window if isinstance(window, Window) else Window(window, window_shape, parameters)
        return self._with(neighbours.average_neighbour_patterns(self.df, self.shape, w, dtype_out=self.dtype))

    def get_neighbour_dot_product_matrices(self, window: Window | None = None, zero_mean: bool = True, normalize: bool = True) -> DataFrame:
        return neighbours.neighbour_dot_products(self.df, self.shape, window, zero_mean, normalize)

    def get_average_neighbour_dot_product_map(self, window: Window | None = None, zero_mean: bool = True, normalize: bool = True, dp_matrices: DataFrame | None = None) -> DataFrame:
        if dp_matrices is not None:
            return neighbours.average_of_dot_products(dp_matrices, window or Window("circular", (3, 3)))
        return neighbours.average_neighbour_dot_product(self.df, self.shape, window, zero_mean, normalize)

    # Virtual imaging
    def get_virtual_bse_intensity(self, region: tuple[int, int, int, int]) -> DataFrame:
        return virtual_image(self.df, self.shape, region)

    def virtual_imager(self, grid_shape: tuple[int, int] | None = None) -> VirtualImager:
        return VirtualImager(self.shape, grid_shape)

    # Selections
    def extract_grid(self, grid_shape: tuple[int, int]) -> Scan:
        nav = self.map_shape()
        (ys, xs), steps = selection.grid_indices(grid_shape, nav, return_spacing=True)
        pick = lambda d: d.filter(F.col("y").isin(ys.tolist()) & F.col("x").isin(xs.tolist()))
        rank = lambda c, at: F.array_position(F.array(*[F.lit(int(v)) for v in at]), F.col(c)).cast("int") - 1
        renumber = lambda d: d.withColumns({"y": rank("y", ys), "x": rank("x", xs)})
        detector = self.detector
        if detector is not None and detector.navigation_shape == nav:
            detector = detector.with_pc(detector.pc[np.ix_(ys, xs)])
        return self._with(renumber(pick(self.df)), nav_shape=(len(ys), len(xs)), xmap=None if self.xmap is None else renumber(pick(self.xmap)), detector=detector, step=(self.step[0] * steps[0], self.step[1] * steps[1]))

    def crop(self, top: int, bottom: int, left: int, right: int) -> Scan:
        """Map rows top to bottom and columns left to right."""
        nav, detector = self.map_shape(), self.detector
        if detector is not None and detector.navigation_shape == nav:
            detector = detector.with_pc(detector.pc[top:bottom, left:right])
        cut = lambda d: selection.crop_navigation(d, top, bottom, left, right)
        return self._with(cut(self.df), nav_shape=(min(bottom, nav[0]) - top, min(right, nav[1]) - left), xmap=None if self.xmap is None else cut(self.xmap), detector=detector)

    def crop_signal(self, top: int, bottom: int, left: int, right: int) -> Scan:
        background = None if self.static_background is None else np.reshape(self.static_background, self.shape)[top:bottom, left:right]
        return self._with(selection.crop_signal(self.df, self.shape, top, bottom, left, right), shape=(bottom - top, right - left), detector=self.detector and self.detector.crop(top, bottom, left, right), static_background=background)

    def inav(self, y: slice | int = slice(None), x: slice | int = slice(None)) -> Scan:
        return self._with(selection.slice_navigation(self.df, y, x), nav_shape=None, xmap=None if self.xmap is None else selection.slice_navigation(self.xmap, y, x))

    def rebin(self, navigation: tuple[int, int] = (1, 1), signal: tuple[int, int] = (1, 1)) -> Scan:
        """Sums over blocks of map points (which lose crystal map and background) and of pixels."""
        out = self
        if navigation != (1, 1):
            nx = -(-self.map_shape()[1] // navigation[1])
            df = selection.rebin_navigation(out.df, navigation).select((F.col("y").cast("bigint") * nx + F.col("x")).alias("idx"), "y", "x", "pixels")
            detector = out.detector and out.detector.with_pc(np.array([0.5, 0.5, 0.5]))
            out = out._with(df, nav_shape=None, xmap=None, static_background=None, detector=detector, step=(self.step[0] * navigation[0], self.step[1] * navigation[1]))
        if signal != (1, 1):
            shape = (self.shape[0] // signal[0], self.shape[1] // signal[1])
            detector = out.detector and replace(out.detector, shape=shape, binning=out.detector.binning * signal[0] if signal[0] == signal[1] else 1)
            out = out._with(selection.rebin_signal(out.df, self.shape, signal), shape=shape, static_background=None, detector=detector)
        return out._with(out.df, dtype="float64")

    def set_scan_calibration(self, step_x: float = 1.0, step_y: float = 1.0) -> Scan:
        return replace(self, step=(step_y, step_x), unit="um")

    def set_detector_calibration(self, delta: float) -> Scan:
        return replace(self, detector=replace(self.detector or Detector(self.shape), px_size=delta))

    # Indexing
    def dictionary_indexing(self, dictionary: DataFrame, metric: str | indexing.SimilarityMetric = "ncc", keep_n: int = 20, navigation_mask: Column | None = None, signal_mask: np.ndarray | None = None, dtype: str = "float32", rotations: DataFrame | None = None) -> DataFrame:
        return indexing.dictionary_indexing(self.df, dictionary, self.n_pixels, metric, keep_n, navigation_mask, signal_mask, dtype, rotations)

    def _points(self, xmap: DataFrame, navigation_mask: Column | None) -> DataFrame:
        points = selection.points_in_data(xmap, navigation_mask)
        first = F.get("rotations", F.lit(0))
        extra = [c for c in ("pcx", "pcy", "pcz") if c in xmap.columns]
        return self.df.join(points.select("idx", "phase_id", *[first[k].alias(k) for k in "abcd"], *extra), "idx")

    def refine_orientation(self, xmap: DataFrame, detector: Detector, master_pattern: MasterPattern, navigation_mask: Column | None = None, **options) -> DataFrame:
        return refinement.refine_orientation(self._points(xmap, navigation_mask), detector, master_pattern, **options)

    def refine_projection_center(self, xmap: DataFrame, detector: Detector, master_pattern: MasterPattern, navigation_mask: Column | None = None, **options) -> DataFrame:
        return refinement.refine_projection_center(self._points(xmap, navigation_mask), detector, master_pattern, **options)

    def refine_orientation_projection_center(self, xmap: DataFrame, detector: Detector, master_pattern: MasterPattern, navigation_mask: Column | None = None, **options) -> DataFrame:
        return refinement.refine_orientation_projection_center(self._points(xmap, navigation_mask), detector, master_pattern, **options)

    # Components
    def get_decomposition_model(self, components=None) -> Scan:
        return self._with(decomposition.decomposition_model(self.df, self.n_pixels, components), dtype="float64")

    # Reductions
    def mean_over_map(self) -> DataFrame:
        return intensity.mean_pattern(self.df)

    def mean_over_pixels(self) -> DataFrame:
        return self.df.withColumn("mean", px.mean(px.doubles(F.col("pixels")))).drop("pixels")

    def sum_over_pixels(self) -> DataFrame:
        return self.df.withColumn("sum", px.total(px.doubles(F.col("pixels")))).drop("pixels")
