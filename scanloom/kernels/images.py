"""Filters and measures of blocks of images, arrays of (n, rows, columns)."""

from __future__ import annotations

import numpy as np


def rescale(images: np.ndarray, out_range: tuple[float, float]) -> np.ndarray:
    """Each image's extremes mapped to ``out_range``; NaN for a constant image."""
    if not len(images):
        return images
    lo, hi = images.min(axis=(1, 2), keepdims=True), images.max(axis=(1, 2), keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = (images - lo) / (hi - lo)
    return np.where(hi > lo, scaled, np.nan) * (out_range[1] - out_range[0]) + out_range[0]


def band_matrix(n: int, weights: np.ndarray, origin: int, edge: str) -> np.ndarray:
    """The matrix that correlates a line of n pixels with ``weights``. edge: "nearest" or "reflect" (the edge pixel twice)."""
    at = np.arange(n)[:, None] + np.arange(len(weights)) - origin
    if edge == "nearest":
        at = np.clip(at, 0, n - 1)
    else:
        at = np.mod(at, 2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), len(weights)), at.ravel()), np.tile(weights, n))
    return out


def gaussian_spatial(shape: tuple[int, int], std: float, truncate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Row and column matrices of a Gaussian blur that reaches ``truncate`` standard deviations."""
    radius = int(truncate * std + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / std) ** 2)
    return tuple(band_matrix(n, w / w.sum(), radius, "reflect") for n in shape)


def gaussian_frequency(shape: tuple[int, int], std: float, truncate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """As the product of a window of int(truncate * std) points a side with the spectrum, edges extended."""
    n = max(1, int(truncate * std))
    w = np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / std) ** 2)
    return tuple(band_matrix(m, w / w.sum(), n // 2, "nearest") for m in shape)


def blur_matrices(shape: tuple[int, int], filter_domain: str, std: float | None, truncate: float) -> tuple[np.ndarray, np.ndarray]:
    std = shape[1] / 8 if std is None else std
    if filter_domain == "frequency":
        return gaussian_frequency(shape, std, truncate)
    if filter_domain == "spatial":
        return gaussian_spatial(shape, std, truncate)
    raise ValueError(f"unknown filter domain {filter_domain!r}, it is 'frequency' or 'spatial'")


def blur(images: np.ndarray, matrices: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return matrices[0] @ images @ matrices[1].T


def correlate(images: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Correlation with a window by Fourier transform, edges extended by their nearest pixel."""
    (rows, cols), (wr, wc) = images.shape[1:], window.shape
    pad = [(0, 0), (wr // 2, wr - 1 - wr // 2), (wc // 2, wc - 1 - wc // 2)]
    padded = np.pad(images, pad, mode="edge")
    size = padded.shape[1:]
    spectrum = np.fft.rfft2(padded) * np.conj(np.fft.rfft2(window, size))
    return np.fft.irfft2(spectrum, size)[:, :rows, :cols]


def fft(images: np.ndarray, apodization: np.ndarray | None = None, shift: bool = False, real_only: bool = False) -> np.ndarray:
    images = images if apodization is None else images * apodization
    out = (np.fft.rfft2 if real_only else np.fft.fft2)(images)
    return np.fft.fftshift(out, axes=(1, 2)) if shift else out


def ifft(spectra: np.ndarray, shift: bool = False, real_only: bool = False, shape: tuple[int, int] | None = None) -> np.ndarray:
    spectra = np.fft.ifftshift(spectra, axes=(1, 2)) if shift else spectra
    return np.fft.irfft2(spectra, shape) if real_only else np.real(np.fft.ifft2(spectra))


def fft_filter(images: np.ndarray, transfer_function: np.ndarray, apodization: np.ndarray | None = None, shift: bool = False) -> np.ndarray:
    """The spectrum times a transfer function. shift: the function has its zero frequency in the middle."""
    return ifft(fft(images, apodization, shift) * transfer_function, shift)


def frequency_weights(shape: tuple[int, int]) -> np.ndarray:
    """Weights of the frequencies of an unshifted spectrum: squared distances, where both halves count from 1."""
    lines = [np.where(np.arange(n) < n // 2, np.arange(n) + 1, np.arange(n) - n) for n in shape]
    return lines[0][:, None] ** 2.0 + lines[1] ** 2.0 - 1


def image_quality(images: np.ndarray, normalize: bool = True) -> np.ndarray:
    """1 less the spectrum's inertia over its greatest possible one; NaN for a constant image that is normalised."""
    if normalize:
        with np.errstate(invalid="ignore", divide="ignore"):
            images = (images - images.mean(axis=(1, 2), keepdims=True)) / images.std(axis=(1, 2), keepdims=True)
    weights = frequency_weights(images.shape[1:])
    with np.errstate(invalid="ignore", divide="ignore"):
        spectrum = np.abs(np.fft.fft2(images))
        return 1 - (spectrum * weights).sum(axis=(1, 2)) / spectrum.sum(axis=(1, 2)) / weights.mean()


def clahe(images: np.ndarray, kernel_size: tuple[int, int] | None = None, clip_limit: float = 0.0, nbins: int = 128) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation to 0..1.

    Images are cut into tiles of ``kernel_size`` (default: a quarter of the image). Each tile has a histogram of ``nbins``
    bins, clipped at ``clip_limit`` of a tile's pixels with the excess spread evenly (0: no clipping), and its cumulated
    histogram maps intensities. A pixel gets the bilinear mean of the maps of the four nearest tiles.
    """
    n, rows, cols = images.shape
    kr, kc = kernel_size or (max(1, rows // 4), max(1, cols // 4))
    lo, hi = images.min(axis=(1, 2), keepdims=True), images.max(axis=(1, 2), keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        level = (images - lo) / (hi - lo)
    constant = (hi == lo)[:, 0, 0]
    level = np.where(constant[:, None, None], 0, level)
    bins = np.minimum((level * nbins).astype(np.int64), nbins - 1)
    tr, tc = -(-rows // kr), -(-cols // kc)
    padded = np.pad(bins, [(0, 0), (0, tr * kr - rows), (0, tc * kc - cols)], mode="symmetric" if tr * kr - rows <= rows and tc * kc - cols <= cols else "edge")
    tiles = padded.reshape(n, tr, kr, tc, kc).transpose(0, 1, 3, 2, 4).reshape(n * tr * tc, kr * kc)
    hist = np.bincount((np.arange(len(tiles))[:, None] * nbins + tiles).ravel(), minlength=len(tiles) * nbins).reshape(-1, nbins).astype(float)
    if clip_limit > 0:
        top = max(1.0, clip_limit * kr * kc)
        excess = np.maximum(hist - top, 0).sum(axis=1, keepdims=True)
        hist = np.minimum(hist, top) + excess / nbins
    maps = (np.cumsum(hist, axis=1) / (kr * kc)).reshape(n, tr, tc, nbins)

    def nearest(size: int, k: int, tiles_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / k - 0.5
        low = np.floor(at)
        return np.clip(low, 0, tiles_ - 1).astype(int), np.clip(low + 1, 0, tiles_ - 1).astype(int), at - low

    r0, r1, fr = nearest(rows, kr, tr)
    c0, c1, fc = nearest(cols, kc, tc)
    pick = lambda r, c: maps[np.arange(n)[:, None, None], r[None, :, None], c[None, None, :], bins]
    fr, fc = fr[None, :, None], fc[None, None, :]
    out = (1 - fr) * ((1 - fc) * pick(r0, c0) + fc * pick(r0, c1)) + fr * ((1 - fc) * pick(r1, c0) + fc * pick(r1, c1))
    out[constant] = np.nan
    return out
