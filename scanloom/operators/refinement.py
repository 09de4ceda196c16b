"""Refinement of orientations and projection centres, pattern by pattern.

The patterns of an Arrow batch are refined together: one Nelder-Mead simplex per pattern, all of them moved at once, so
each step projects the master pattern for a whole block. Nothing shuffles, and a pattern's result depends on it alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from scanloom.kernels import geometry as kg
from scanloom.kernels import optimise
from scanloom.kernels.blocks import to_block
from scanloom.operators.detector import Detector
from scanloom.operators.master_pattern import MASTER_BYTES, MasterPattern
from scanloom.storage import bounded_batches

#: Patterns refined together at most, bytes of them, and pixels projected at once.
TOGETHER, BYTES, AT_ONCE = 1024, 32 << 20, 1 << 15
#: Where the sine of Phi is less, the first and last Bunge angles turn about nearly the same axis, and small turns about
#: another one are far away in them. There, angles are those of the rotation times ASIDE, whose Phi is near 90 degrees.
POLE, ASIDE = 0.25, np.array([np.sqrt(0.5), np.sqrt(0.5), 0.0, 0.0])
METHODS = ("minimize", "ln_neldermead", "nelder-mead", "differential_evolution", "basinhopping", "dual_annealing", "shgo")
_GLOBAL = {"basinhopping": optimise.basin_hopping, "dual_annealing": optimise.dual_annealing, "shgo": optimise.shgo}
_NAMES = {"orientation": ("phi1", "Phi", "phi2"), "pc": ("pcx", "pcy", "pcz")}
#: Farthest values that a search may take: Bunge angles in radians with 5 degrees to spare, and projection centres.
_LEAST = {"orientation": np.deg2rad([-5.0, -5.0, -5.0]), "pc": np.array([-2.0, -2.0, -2.0])}
_MOST = {"orientation": np.deg2rad([365.0, 185.0, 365.0]), "pc": np.array([2.0, 2.0, 2.0])}
_FIRST_STEP = {"orientation": np.deg2rad([1.0, 1.0, 1.0]), "pc": np.array([0.01, 0.01, 0.01])}


def bounds(kinds: Sequence[str], x0: np.ndarray, trust_region: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (n, d) around x0. trust_region: half-widths, angles in degrees; none is the whole range. Near the
    poles of Phi angles are about other axes, see POLE."""
    least, most = (np.concatenate([t[k] for k in kinds]) for t in (_LEAST, _MOST))
    if trust_region is None:
        return np.broadcast_to(least, x0.shape).copy(), np.broadcast_to(most, x0.shape).copy()
    reach = np.array(trust_region, float)
    if len(reach) != x0.shape[1]:
        raise ValueError(f"a trust region has {x0.shape[1]} half-widths")
    if kinds[0] == "orientation":
        reach[:3] = np.deg2rad(reach[:3])
    return np.maximum(x0 - reach, least), np.minimum(x0 + reach, most)


def _prepared(patterns: np.ndarray) -> np.ndarray:
    p = patterns - patterns.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return p / np.linalg.norm(p, axis=1, keepdims=True)


def correlation(patterns: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of patterns (n, pixels) with one other pattern, or with as many."""
    return (_prepared(patterns) * _prepared(np.atleast_2d(other))).sum(axis=1)


def refine_block(patterns: np.ndarray, q: np.ndarray, pc: np.ndarray, kinds: Sequence[str], master: np.ndarray, shape: tuple[int, int], to_detector: np.ndarray, kept: np.ndarray | None = None, method: str = "minimize", trust_region: Sequence[float] | None = None, initial_step: Sequence[float] | None = None, tol: float = 1e-4, max_iter: int | None = None, ops: np.ndarray | None = None, seed: int = 0) -> dict[str, np.ndarray]:
    """Scores (NCC), refined quaternions and projection centres, evaluations and the pseudo-symmetry operation that won, 0
    for none, of patterns (n, pixels)."""
    n = len(patterns)
    ready = _prepared(patterns if kept is None else patterns[:, kept])
    starts = [q] if ops is None else [q, *(kg.product(np.broadcast_to(o, q.shape), q) for o in ops)]
    every = np.tile(np.arange(n), len(starts))
    q = np.concatenate(starts)
    pc = np.tile(pc, (len(starts), 1))
    polar = np.sin(kg.euler_from_quaternion(q)[:, 1]) < POLE if "orientation" in kinds else np.zeros(len(q), bool)
    aside = np.where(polar[:, None], ASIDE, [1.0, 0.0, 0.0, 0.0])
    back = aside * [1, -1, -1, -1]
    fixed = kg.direction_cosines(shape, pc, to_detector, kept) if "pc" not in kinds and n else None
    x0 = np.concatenate([kg.euler_from_quaternion(kg.product(q, aside)) if k == "orientation" else pc for k in kinds], axis=1)
    lower, upper = bounds(kinds, x0, trust_region)

    def split(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = kg.quaternion_from_euler(x[:, :3]) if "orientation" in kinds else q[rows]
        if polar[rows].any():
            turned = kg.product(turned, back[rows])
        return turned, (x[:, -3:] if "pc" in kinds else pc[rows])

    def loss(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        at_once = max(1, AT_ONCE // max(1, ready.shape[1]))
        for k in range(0, len(rows), at_once):
            some = slice(k, k + at_once)
            turned, at = split(rows[some], x[some])
            seen = kg.project(master, turned, fixed[rows[some]]) if fixed is not None else kg.project_from(master, turned, shape, at, to_detector, kept)
            seen -= seen.mean(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[some] = 1 - np.einsum("ij,ij->i", ready[every[rows[some]]], seen) / np.sqrt(np.einsum("ij,ij->i", seen, seen))
        return out

    if method == "differential_evolution":
        x, value, count = optimise.differential_evolution(loss, lower, upper, x0, seed=seed)
    else:
        step = np.concatenate([_FIRST_STEP[k] for k in kinds])
        if initial_step is not None:
            step = np.repeat(np.array(initial_step, float), 3)
            if kinds[0] == "orientation":
                step[:3] = np.deg2rad(step[:3])
        local = {"xtol": tol, "ftol": tol, "max_iter": max_iter}
        search = _GLOBAL.get(method, optimise.nelder_mead)
        x, value, count = search(loss, x0, step, lower, upper, **local, **({"seed": seed} if method in ("basinhopping", "dual_annealing") else {}))
    best = value.reshape(len(starts), n).argmin(axis=0)
    won = best * n + np.arange(n)
    turned, at = split(won, x[won])
    return {"score": 1 - value[won], "q": turned, "pc": at, "num_evals": count[won], "pseudo_symmetry_index": best}


def refine(points: DataFrame, kinds: Sequence[str], detector: Detector, master_pattern: MasterPattern, energy: float | None = None, signal_mask: np.ndarray | None = None, method: str = "minimize", trust_region: Sequence[float] | None = None, initial_step: Sequence[float] | None = None, tol: float = 1e-4, max_iter: int | None = None, pseudo_symmetry_ops: np.ndarray | None = None, column: str = "pixels") -> DataFrame:
    """The columns of ``points`` without the patterns, with a, b, c, d and pcx, pcy, pcz refined, and score, num_evals and,
    with ``pseudo_symmetry_ops``, pseudo_symmetry_index (0: none of them).

    ``points`` has patterns, rotations (a, b, c, d), and pcx, pcy, pcz unless the detector has one projection centre.
    Points with a null among these, or a constant pattern, keep what they have and get a null score.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, it is one of {METHODS}")
    master = master_pattern.for_projection(energy)
    if master.nbytes > MASTER_BYTES:
        raise ValueError(f"a master pattern of {master.nbytes} bytes can't be sent to all tasks")
    if "pcx" not in points.columns:
        if detector.navigation_size != 1:
            raise ValueError("a detector with several projection centres needs points with pcx, pcy and pcz")
        points = points.withColumns({n: F.lit(float(v)) for n, v in zip(("pcx", "pcy", "pcz"), detector.pc_flattened[0], strict=True)})
    spark = points.sparkSession
    together = max(1, min(TOGETHER, BYTES // (8 * detector.size)))
    bounded_batches(spark, together)
    sent = spark.sparkContext.broadcast(master)
    shape, to_detector = detector.shape, detector.sample_to_detector
    kept = None if signal_mask is None else ~np.asarray(signal_mask, bool).ravel()
    numbers = ["a", "b", "c", "d", "pcx", "pcy", "pcz"]
    rest = [f for f in points.schema if f.name not in (column, *numbers)]
    results = [StructField("score", DoubleType()), StructField("num_evals", IntegerType())] + [StructField("pseudo_symmetry_index", IntegerType())] * (pseudo_symmetry_ops is not None)
    schema = StructType([*rest, *[StructField(n, DoubleType()) for n in numbers], *results])
    ops = None if pseudo_symmetry_ops is None else np.atleast_2d(np.asarray(pseudo_symmetry_ops, float))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                b = batch.slice(at, together)
                block, whole = to_block(b.column(column), shape[0] * shape[1])
                v = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in numbers], axis=1)
                fine = whole & np.isfinite(v).all(axis=1)
                own = block[fine[whole]]
                varied = np.ptp(own, axis=1) > 0 if len(own) else np.zeros(0, bool)
                fine[np.flatnonzero(fine)[~varied]] = False
                own = own[varied]
                score, more = np.full(b.num_rows, np.nan), {n: np.zeros(b.num_rows, np.int32) for n in ("num_evals", "pseudo_symmetry_index")}
                if len(own):
                    out = refine_block(own, v[fine, :4], v[fine, 4:], kinds, sent.value, shape, to_detector, kept, method, trust_region, initial_step, tol, max_iter, ops)
                    v[fine] = np.concatenate([out["q"], out["pc"]], axis=1)
                    score[fine] = out["score"]
                    for n in more:
                        more[n][fine] = out[n]
                arrays = [b.column(f.name) for f in rest] + [pa.array(v[:, k], mask=np.isnan(v[:, k])) for k in range(7)]
                arrays += [pa.array(score, mask=~fine)] + [pa.array(more[f.name], mask=~fine) for f in results[1:]]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return points.mapInArrow(run, schema)


def refine_orientation(points: DataFrame, detector: Detector, master_pattern: MasterPattern, **options) -> DataFrame:
    """Three Bunge angles are varied; see ``refine``."""
    return refine(points, ["orientation"], detector, master_pattern, **options)


def refine_projection_center(points: DataFrame, detector: Detector, master_pattern: MasterPattern, **options) -> DataFrame:
    """The projection centre's three coordinates are varied; see ``refine``."""
    return refine(points, ["pc"], detector, master_pattern, **options)


def refine_orientation_projection_center(points: DataFrame, detector: Detector, master_pattern: MasterPattern, **options) -> DataFrame:
    """Both are varied, six numbers in all; see ``refine``."""
    return refine(points, ["orientation", "pc"], detector, master_pattern, **options)
