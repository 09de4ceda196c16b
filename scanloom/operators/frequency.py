"""Patterns in the frequency domain, as Arrow kernels. Nothing shuffles; transfer functions travel with the task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scanloom.functions import pixels as px
from scanloom.functions.windows import Window
from scanloom.kernels import images
from scanloom.kernels.blocks import double, doubles, map_patterns


def fft(df: DataFrame, shape: tuple[int, int], apodization: np.ndarray | None = None, shift: bool = False, column: str = "pixels") -> DataFrame:
    """Adds ``re`` and ``im``, the spectrum's parts in row-major order."""
    out = StructType([StructField(n, ArrayType(DoubleType())) for n in ("re", "im")])

    def kernel(b: np.ndarray) -> dict[str, np.ndarray]:
        s = images.fft(b.reshape(-1, *shape), apodization, shift).reshape(len(b), -1)
        return {"re": s.real.copy(), "im": s.imag.copy()}

    return map_patterns(df, kernel, out, shape[0] * shape[1], column)


def ifft(df: DataFrame, shape: tuple[int, int], shift: bool = False, column: str = "pixels") -> DataFrame:
    """The real part of the inverse transform of ``re`` and ``im``, as ``pixels``; the two are dropped."""
    both = df.withColumn("_spectrum", F.concat("re", "im"))
    n = shape[0] * shape[1]

    def kernel(b: np.ndarray) -> dict[str, np.ndarray]:
        return {column: images.ifft((b[:, :n] + 1j * b[:, n:]).reshape(-1, *shape), shift).reshape(len(b), -1)}

    return map_patterns(both, kernel, doubles(column), 2 * n, "_spectrum", drop=["_spectrum", "re", "im"])


def fft_spectrum(df: DataFrame, shape: tuple[int, int], column: str = "pixels") -> DataFrame:
    """Adds ``spectrum``, the amplitudes of the unshifted transform."""
    return map_patterns(df, lambda b: {"spectrum": np.abs(np.fft.fft2(b.reshape(-1, *shape))).reshape(len(b), -1)}, doubles("spectrum"), shape[0] * shape[1], column)


def fft_filter(df: DataFrame, shape: tuple[int, int], transfer_function: np.ndarray | Window, function_domain: str = "frequency", shift: bool = False, rescale_to: tuple[float, float] | None = None, dtype_out: str | None = None, column: str = "pixels") -> DataFrame:
    """Patterns filtered with a transfer function (``frequency``), or correlated with a window (``spatial``) with edges
    extended; rescaled to ``rescale_to`` or the range of ``dtype_out``, if given."""
    w = transfer_function.values if isinstance(transfer_function, Window) else np.asarray(transfer_function, float)
    if function_domain not in ("frequency", "spatial"):
        raise ValueError(f"unknown function domain {function_domain!r}, it is 'frequency' or 'spatial'")
    if function_domain == "frequency" and w.shape != tuple(shape):
        raise ValueError(f"a transfer function of shape {w.shape} doesn't fit patterns of shape {shape}")
    to = rescale_to if rescale_to is not None else px.dtype_range(dtype_out) if dtype_out else None

    def kernel(b: np.ndarray) -> dict[str, np.ndarray]:
        b = b.reshape(-1, *shape)
        out = images.fft_filter(b, w, shift=shift) if function_domain == "frequency" else images.correlate(b, w)
        return {column: (out if to is None else images.rescale(out, to)).reshape(len(b), -1)}

    out = map_patterns(df, kernel, doubles(column), shape[0] * shape[1], column)
    return out if dtype_out is None else out.withColumn(column, px.to_dtype(F.col(column), dtype_out))


def image_quality(df: DataFrame, shape: tuple[int, int], normalize: bool = True, column: str = "pixels") -> DataFrame:
    """Adds ``iq``: 1 for a pattern without high frequencies, about 0 for noise, null for a constant one if normalised."""
    return map_patterns(df, lambda b: {"iq": images.image_quality(b.reshape(-1, *shape), normalize)}, double("iq"), shape[0] * shape[1], column)
