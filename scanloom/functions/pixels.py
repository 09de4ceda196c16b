"""Column expressions over a pattern: an array column with the pixels in row-major order.

All of them are row-local: a plan made of them is one projection without a shuffle, and it streams. Values that a whole
pattern shares, such as its least pixel, are bound once with ``let``; inside a lambda they would be computed again for
each pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest values of a data type's range; floats count as -1 to 1.
DTYPE_RANGES = {
    "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "int8": (-128, 127), "int16": (-32768, 32767),
    "int32": (-2147483648, 2147483647), "float16": (-1, 1), "float32": (-1, 1), "float64": (-1, 1),
}
#: The element type that holds a data type's values. Spark has no unsigned integers.
ELEMENT_TYPES = {
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int",
    "int64": "bigint", "float16": "float", "float32": "float", "float64": "double",
}


def dtype_range(dtype: str) -> tuple[float, float]:
    return DTYPE_RANGES[dtype]


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each of which is computed once per row."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), body), F.lit(0))


def literal(values: Sequence[float] | np.ndarray) -> Column:
    """An array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in np.ravel(values)])


def doubles(p: Column) -> Column:
    return p.cast("array<double>")


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v)


def mean(p: Column) -> Column:
    return total(p) / F.size(p)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def affine(p: Column, lo: Column, hi: Column, out_range: tuple[float, float], clip: bool = False) -> Column:
    """Maps lo to out_range[0] and hi to out_range[1]; null where lo and hi agree."""
    a, b = map(float, out_range)

    def body(s: Column) -> Column:
        inside = (lambda v: F.greatest(F.least(v, s["hi"]), s["lo"])) if clip else (lambda v: v)
        return F.when(s["hi"] != s["lo"], F.transform(s["p"], lambda v: (inside(v) - s["lo"]) / (s["hi"] - s["lo"]) * (b - a) + a))

    return let(body, p=doubles(p), lo=lo.cast("double"), hi=hi.cast("double"))


def rescale(p: Column, out_range: tuple[float, float], in_range: tuple[float, float] | None = None) -> Column:
    """Intensities mapped to ``out_range``, from the pattern's own extremes or, clipped, from ``in_range``."""
    if in_range is not None:
        return affine(p, F.lit(float(in_range[0])), F.lit(float(in_range[1])), out_range, clip=True)
    return affine(p, F.array_min(p), F.array_max(p), out_range)


def percentile(sorted_p: Column, q: float) -> Column:
    """Linearly interpolated percentile of an ascending array."""
    return let(
        lambda s: s["p"][s["k"]] + (s["h"] - s["k"]) * (s["p"][F.least(s["k"] + 1, F.size(s["p"]) - 1)] - s["p"][s["k"]]),
        p=sorted_p,
        h=(F.size(sorted_p) - 1) * (q / 100.0),
        k=F.floor((F.size(sorted_p) - 1) * (q / 100.0)).cast("int"),
    )


def rescale_percentiles(p: Column, percentiles: tuple[float, float], out_range: tuple[float, float]) -> Column:
    """As ``rescale``, clipped to the pattern's own percentiles."""
    return let(lambda s: affine(s["p"], percentile(s["o"], percentiles[0]), percentile(s["o"], percentiles[1]), out_range, clip=True), p=doubles(p), o=F.sort_array(doubles(p)))


def centre(p: Column) -> Column:
    return let(lambda s: F.transform(s["p"], lambda v: v - s["m"]), p=doubles(p), m=mean(doubles(p)))


def unit(p: Column) -> Column:
    """Divided by the L2 norm; null for a pattern of zeros."""
    return let(lambda s: F.when(s["n"] > 0, F.transform(s["p"], lambda v: v / s["n"])), p=doubles(p), n=F.sqrt(dot(doubles(p), doubles(p))))


def normalize(p: Column, num_std: float = 1, divide_by_square_root: bool = False) -> Column:
    """Mean 0 and (population) standard deviation 1 / num_std, also over the root of the size; null if all pixels agree."""
    centred = centre(p)

    def body(s: Column) -> Column:
        by = s["d"] * float(num_std) * (F.sqrt(F.size(s["c"]).cast("double")) if divide_by_square_root else F.lit(1.0))
        return let(lambda t: F.when(t["by"] > 0, F.transform(t["c"], lambda v: v / t["by"])), c=s["c"], by=by)

    return let(body, c=centred, d=let(lambda s: F.sqrt(dot(s["c"], s["c"]) / F.size(s["c"])), c=centred))


def remove_background(p: Column, background: Column, operation: str, out_range: tuple[float, float], scale: bool = False) -> Column:
    """The pattern less its background, or divided by it, rescaled to ``out_range``. With ``scale`` the background is
    first mapped to the pattern's own range. A background pixel of 0 gives null when dividing."""
    if operation not in ("subtract", "divide"):
        raise ValueError(f"unknown operation {operation!r}, it is 'subtract' or 'divide'")

    def apply(p: Column, b: Column) -> Column:
        f = (lambda x, y: x - y) if operation == "subtract" else (lambda x, y: F.when(y != 0, x / y))
        return let(lambda s: rescale(s["d"], out_range), d=F.zip_with(p, b, f))

    if not scale:
        return let(lambda s: apply(s["p"], s["b"]), p=doubles(p), b=doubles(background))

    def scaled(s: Column) -> Column:
        b = F.transform(s["b"], lambda v: (v - s["bl"]) / (s["bh"] - s["bl"]) * (s["ph"] - s["pl"]) + s["pl"])
        return let(lambda t: apply(t["p"], t["b"]), p=s["p"], b=b)

    return let(scaled, p=doubles(p), b=doubles(background), bl=F.array_min(background), bh=F.array_max(background), pl=F.array_min(p), ph=F.array_max(p))


def block_sum(p: Column, shape: tuple[int, int], factor: tuple[int, int]) -> Column:
    """Sums over blocks of factor[0] x factor[1] pixels; the factors divide the shape."""
    (rows, cols), (fr, fc) = shape, factor
    if rows % fr or cols % fc:
        raise ValueError(f"factors {factor} don't divide the shape {shape}")
    starts = [r * fr * cols + c * fc for r in range(rows // fr) for c in range(cols // fc)]
    offsets = F.array(*[F.lit(r * cols + c) for r in range(fr) for c in range(fc)])
    at = F.array(*[F.lit(s) for s in starts])
    return let(lambda s: F.transform(s["at"], lambda i: F.aggregate(s["off"], F.lit(0.0), lambda a, o: a + s["p"][i + o])), p=doubles(p), at=at, off=offsets)


def crop(p: Column, shape: tuple[int, int], top: int, bottom: int, left: int, right: int) -> Column:
    """Rows top to bottom and columns left to right, the ends excluded."""
    cols = shape[1]
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(bottom - 1)), lambda r: F.slice(p, r * cols + left + 1, right - left)))


def region_sum(p: Column, shape: tuple[int, int], top: int, bottom: int, left: int, right: int) -> Column:
    return total(doubles(crop(p, shape, top, bottom, left, right)))


def keep_pixels(p: Column, excluded: Sequence[bool]) -> Column:
    """Without the pixels for which the mask is true."""
    kept = F.array(*[F.lit(int(i)) for i in np.flatnonzero(~np.asarray(excluded, bool).ravel())])
    return let(lambda s: F.transform(s["k"], lambda i: s["p"][i]), p=p, k=kept)


def to_dtype(p: Column, dtype: str) -> Column:
    """Elements cast to a data type; fractions are cut off, as in an integer cast."""
    return p.cast(f"array<{ELEMENT_TYPES[dtype]}>")
