"""Windows and transfer functions in closed form, as NumPy arrays. They are made once, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def distance_to_origin(shape: tuple[int, ...], origin: tuple[int, ...] | None = None) -> np.ndarray:
    """Radial distance of each point to the origin, by default the middle (shape // 2)."""
    origin = tuple(n // 2 for n in shape) if origin is None else origin
    return np.sqrt(sum((np.arange(n).reshape([-1 if k == i else 1 for k in range(len(shape))]) - o) ** 2.0 for i, (n, o) in enumerate(zip(shape, origin, strict=True))))


def modified_hann(n: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) - (n - 1) / 2) / n)


def lowpass_fft_filter(shape: tuple[int, int], cutoff: float, cutoff_width: float | None = None) -> np.ndarray:
    """1 up to the cut-off frequency, falling off as a Gaussian, 0 from two widths beyond it."""
    width = cutoff / 2 if cutoff_width is None else cutoff_width
    beyond = distance_to_origin(shape) - cutoff
    return np.where(beyond < 0, 1.0, np.where(beyond > 2 * width, 0.0, np.exp(-2 * (beyond / width) ** 2)))


def highpass_fft_filter(shape: tuple[int, int], cutoff: float, cutoff_width: float | None = None) -> np.ndarray:
    """1 from the cut-off frequency on, falling off as a Gaussian, 0 from two widths below it."""
    width = cutoff / 2 if cutoff_width is None else cutoff_width
    below = cutoff - distance_to_origin(shape)
    return np.where(below < 0, 1.0, np.where(below > 2 * width, 0.0, np.exp(-2 * (below / width) ** 2)))


def gaussian(n: int, std: float) -> np.ndarray:
    return np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / std) ** 2)


def _cosines(n: int, weights: tuple[float, ...]) -> np.ndarray:
    if n == 1:
        return np.ones(1)
    at = np.linspace(-np.pi, np.pi, n)
    return sum(w * np.cos(k * at) for k, w in enumerate(weights))


#: Symmetric one-dimensional windows by name.
ONE_DIMENSIONAL = {
    "modified_hann": modified_hann,
    "boxcar": np.ones,
    "hann": lambda n: _cosines(n, (0.5, 0.5)),
    "hamming": lambda n: _cosines(n, (0.54, 0.46)),
    "blackman": lambda n: _cosines(n, (0.42, 0.5, 0.08)),
    "nuttall": lambda n: _cosines(n, (0.3635819, 0.4891775, 0.1365995, 0.0106411)),
    "blackmanharris": lambda n: _cosines(n, (0.35875, 0.48829, 0.14128, 0.01168)),
    "flattop": lambda n: _cosines(n, (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)),
    "bartlett": np.bartlett,
    "triang": lambda n: 1 - np.abs((np.arange(n) - (n - 1) / 2) / ((n + n % 2) / 2)),
    "cosine": lambda n: np.sin(np.pi / n * (np.arange(n) + 0.5)),
    "parzen": lambda n: _parzen(n),
    "bohman": lambda n: _bohman(n),
    "gaussian": gaussian,
    "kaiser": np.kaiser,
    "exponential": lambda n, tau=1.0: np.exp(-np.abs(np.arange(n) - (n - 1) / 2) / tau),
    "tukey": lambda n, alpha=0.5: _tukey(n, alpha),
}


def _parzen(n: int) -> np.ndarray:
    at = np.abs(np.arange(n) - (n - 1) / 2) / (n / 2)
    return np.where(at <= 0.5, 1 - 6 * at**2 * (1 - at), 2 * (1 - at) ** 3)


def _bohman(n: int) -> np.ndarray:
    at = np.abs(np.linspace(-1, 1, n))
    out = (1 - at) * np.cos(np.pi * at) + np.sin(np.pi * at) / np.pi
    out[[0, -1]] = 0
    return out


def _tukey(n: int, alpha: float) -> np.ndarray:
    if alpha <= 0 or n == 1:
        return np.ones(n)
    at = np.arange(n) / (n - 1)
    at = np.minimum(at, 1 - at)
    return np.where(at < alpha / 2, 0.5 * (1 - np.cos(2 * np.pi * at / alpha)), 1.0)


@dataclass(frozen=True)
class Window:
    """A window with a name and an origin (the middle). 2-D windows are outer products of 1-D ones.

    name: "circular", "rectangular", "lowpass", "highpass", a key of ONE_DIMENSIONAL, or "custom" with ``values``.
    """

    name: str = "circular"
    shape: tuple[int, ...] = (3, 3)
    parameters: dict = field(default_factory=dict)
    values: np.ndarray | None = None

    def __post_init__(self) -> None:
        shape = tuple(self.shape if self.values is None else np.shape(self.values))
        if any(int(n) != n or n < 1 for n in shape):
            raise ValueError(f"a window's shape has positive whole numbers, not {shape}")
        object.__setattr__(self, "shape", shape)
        object.__setattr__(self, "values", self._make() if self.values is None else np.asarray(self.values, float))

    def _make(self) -> np.ndarray:
        if self.name in ("circular", "rectangular"):
            ones = np.ones(self.shape)
            return np.where(distance_to_origin(self.shape) > max(self.origin), 0.0, ones) if self.name == "circular" else ones
        if self.name in ("lowpass", "highpass"):
            return (lowpass_fft_filter if self.name == "lowpass" else highpass_fft_filter)(self.shape, **self.parameters)
        if self.name not in ONE_DIMENSIONAL:
            raise ValueError(f"unknown window {self.name!r}")
        parts = [ONE_DIMENSIONAL[self.name](n, **self.parameters) for n in self.shape]
        return parts[0] if len(parts) == 1 else np.outer(*parts)

    @property
    def origin(self) -> tuple[int, ...]:
        return tuple(n // 2 for n in self.shape)

    @property
    def distance_to_origin(self) -> np.ndarray:
        return distance_to_origin(self.shape)

    @property
    def n_neighbours(self) -> tuple[int, ...]:
        """How far the window reaches from its origin."""
        return tuple(n - o - 1 for n, o in zip(self.shape, self.origin, strict=True))

    @property
    def is_valid(self) -> bool:
        return bool(np.isfinite(self.values).all())

    def make_circular(self) -> Window:
        """Zero beyond the greatest origin coordinate."""
        return Window("circular" if self.name == "rectangular" else self.name, self.shape, self.parameters, np.where(self.distance_to_origin > max(self.origin), 0.0, self.values))

    def shape_compatible(self, shape: tuple[int, ...]) -> bool:
        return len(self.shape) <= len(shape) and all(a <= b for a, b in zip(self.shape, shape, strict=False))

    def offsets(self) -> list[tuple[int, int, float]]:
        """(dy, dx, weight) of the points that aren't zero; a 1-D window lies along x."""
        grid = np.atleast_2d(self.values)
        oy, ox = (0, *self.origin)[-2:]
        return [(int(r) - oy, int(c) - ox, float(grid[r, c])) for r, c in zip(*np.nonzero(grid), strict=True)]
