"""Master patterns and the patterns that they predict for rotations and a detector."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scanloom.functions import pixels as px
from scanloom.kernels import geometry as kg
from scanloom.kernels import images
from scanloom.operators.detector import Detector
from scanloom.storage import bounded_batches

#: Bytes of a master pattern of one energy that is sent to all tasks at most: two hemispheres of 8000 x 8000 doubles.
MASTER_BYTES = 1 << 30
#: Pixels projected at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class MasterPattern:
    """Images of one phase's sphere: ``upper`` and ``lower`` (energies, n, n), or one of them if the phase has a centre of
    symmetry. projection is "stereographic" or "lambert"."""

    upper: np.ndarray | None
    lower: np.ndarray | None = None
    projection: str = "stereographic"
    energies: tuple[float, ...] = (0.0,)
    phase: str = ""
    centrosymmetric: bool = True
    kind: str = "EBSD"

    def __post_init__(self) -> None:
        for name in ("upper", "lower"):
            v = getattr(self, name)
            if v is not None:
                v = np.asarray(v, float)
                object.__setattr__(self, name, v[None] if v.ndim == 2 else v)
        if self.upper is None and self.lower is None:
            raise ValueError("a master pattern has an upper or a lower hemisphere")
        if self.projection not in ("stereographic", "lambert"):
            raise ValueError("a projection is 'stereographic' or 'lambert'")

    @property
    def hemisphere(self) -> str:
        return "both" if self.upper is not None and self.lower is not None else "upper" if self.lower is None else "lower"

    def at_energy(self, energy: float | None = None) -> np.ndarray:
        """(2, n, n): both hemispheres at the nearest energy, the greatest by default."""
        k = len(self.energies) - 1 if energy is None else int(np.argmin(np.abs(np.array(self.energies) - energy)))
        one = self.upper if self.upper is not None else self.lower
        return np.stack([one[k], (self.lower if self.lower is not None else one)[k]])

    def for_projection(self, energy: float | None = None) -> np.ndarray:
        if self.projection != "lambert":
            raise ValueError("patterns are made from the Lambert projection, see as_lambert()")
        if self.hemisphere != "both" and not self.centrosymmetric:
            raise ValueError("a phase without a centre of symmetry needs both hemispheres")
        return self.at_energy(energy)

    def as_lambert(self) -> MasterPattern:
        """Resampled from the stereographic to the Lambert projection, by bilinear interpolation."""
        if self.projection == "lambert":
            return self

        def resampled(v: np.ndarray | None) -> np.ndarray | None:
            if v is None:
                return None
            n = v.shape[1]
            at = np.linspace(-1, 1, n)
            x, y = np.meshgrid(at, at)
            xy = kg.vector_to_stereographic(kg.lambert_to_vector(np.stack([x, y], axis=-1)))
            col, row = ((xy[..., k] + 1) / 2 * (n - 1) for k in (0, 1))
            r0, c0 = np.clip(row.astype(int), 0, n - 2), np.clip(col.astype(int), 0, n - 2)
            fr, fc = row - r0, col - c0
            return (1 - fr) * ((1 - fc) * v[:, r0, c0] + fc * v[:, r0, c0 + 1]) + fr * ((1 - fc) * v[:, r0 + 1, c0] + fc * v[:, r0 + 1, c0 + 1])

        return replace(self, upper=resampled(self.upper), lower=resampled(self.lower), projection="lambert")

    def _mapped(self, f) -> MasterPattern:
        return replace(self, **{n: None if getattr(self, n) is None else f(getattr(self, n)) for n in ("upper", "lower")})

    def rescale_intensity(self, out_range: tuple[float, float] = (-1, 1), relative: bool = False) -> MasterPattern:
        both = [v for v in (self.upper, self.lower) if v is not None]
        lo, hi = min(v.min() for v in both), max(v.max() for v in both)
        if relative:
            return self._mapped(lambda v: (v - lo) / (hi - lo) * (out_range[1] - out_range[0]) + out_range[0])
        return self._mapped(lambda v: images.rescale(v, out_range))

    def normalize_intensity(self, num_std: float = 1) -> MasterPattern:
        return self._mapped(lambda v: (v - v.mean(axis=(1, 2), keepdims=True)) / (num_std * v.std(axis=(1, 2), keepdims=True)))

    def adaptive_histogram_equalization(self, clip_limit: float = 0.0, nbins: int = 128) -> MasterPattern:
        return self._mapped(lambda v: images.clahe(v, clip_limit=clip_limit, nbins=nbins))

    def get_patterns(self, rotations: DataFrame, detector: Detector, energy: float | None = None, dtype_out: str | None = None) -> DataFrame:
        """``rotations`` (a, b, c, d, and pcx, pcy, pcz if each has its own projection centre) with ``pixels``.

        Rescaled to the range of ``dtype_out`` if that is given. A row with nulls among those gives null. Rotations don't
        shuffle; the master pattern of one energy, whose size is checked, is sent to the tasks.
        """
        return project_patterns(rotations, self.for_projection(energy), detector, dtype_out)


def project_patterns(rotations: DataFrame, master: np.ndarray, detector: Detector, dtype_out: str | None = None) -> DataFrame:
    if master.nbytes > MASTER_BYTES:
        raise ValueError(f"a master pattern of {master.nbytes} bytes can't be sent to all tasks")
    own_pc = "pcx" in rotations.columns
    if not own_pc and detector.navigation_size != 1:
        raise ValueError("a detector with several projection centres needs rotations with pcx, pcy and pcz")
    spark = rotations.sparkSession
    bounded_batches(spark, max(1, min(1000, (32 << 20) // (8 * detector.size))))
    sent = spark.sparkContext.broadcast(master)
    shape, to_detector = detector.shape, detector.sample_to_detector
    cosines = None if own_pc else kg.direction_cosines(shape, detector.pc_flattened[0], to_detector)
    names = ["a", "b", "c", "d"] + ["pcx", "pcy", "pcz"] * own_pc
    kept = [f for f in rotations.schema if f.name != "pixels"]
    schema = StructType([*kept, StructField("pixels", ArrayType(DoubleType()))])
    to = px.dtype_range(dtype_out) if dtype_out else None

    def run(batches):
        for b in batches:
            v = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1) if b.num_rows else np.zeros((0, len(names)))
            fine = np.isfinite(v).all(axis=1)
            v = v[fine]
            out = np.empty((len(v), shape[0] * shape[1]))
            step = max(1, AT_ONCE // out.shape[1])
            for k in range(0, len(v), step):
                part = slice(k, k + step)
                seen = cosines if not own_pc else kg.direction_cosines(shape, v[part, 4:], to_detector)
                out[part] = kg.project(sent.value, v[part, :4], seen)
            if to is not None and len(out):
                out = images.rescale(out.reshape(-1, *shape), to).reshape(len(out), -1)
            ends = np.concatenate([[0], np.cumsum(np.where(fine, out.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~fine))], [f.name for f in schema])

    out = rotations.mapInArrow(run, schema)
    return out if dtype_out is None else out.withColumn("pixels", px.to_dtype(out["pixels"], dtype_out))


def euler_grid(spark: SparkSession, step: float, max_euler: tuple[float, float, float] = (360.0, 180.0, 360.0)) -> DataFrame:
    """(sim_idx, a, b, c, d): rotations on a regular grid of Bunge angles, ``step`` degrees apart, made by the executors."""
    from pyspark.sql import functions as F

    from scanloom.functions import geometry as geo

    n1, n2, n3 = int(np.ceil(max_euler[0] / step)), int(np.floor(max_euler[1] / step)) + 1, int(np.ceil(max_euler[2] / step))
    i = F.col("id")
    angles = [F.radians(c * float(step)) for c in (F.floor(i / (n2 * n3)), F.floor(i / n3) % n2, i % n3)]
    q = geo.euler_to_quaternion(*angles)
    return spark.range(n1 * n2 * n3).select(F.col("id").alias("sim_idx"), *[c.alias(n) for n, c in zip("abcd", q, strict=True)])
