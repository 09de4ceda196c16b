"""Crystal maps: merging the maps of several phases, and comparing phases. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.storage import materialise


@dataclass(frozen=True)
class Phase:
    name: str
    space_group: int | None = None
    lattice: tuple[float, float, float, float, float, float] | None = None
    atoms: tuple[tuple[str, float, float, float], ...] = ()


def different_in(one: Phase, other: Phase, tol: float = 1e-4) -> list[str]:
    """What tells two phases apart; empty if they are equal."""
    out = [n for n in ("name", "space_group") if getattr(one, n) != getattr(other, n)]
    if (one.lattice is None) != (other.lattice is None) or (one.lattice is not None and not np.allclose(one.lattice, other.lattice, atol=tol)):
        out.append("lattice")
    if len(one.atoms) != len(other.atoms):
        out.append("number of atoms")
    elif any(a[0] != b[0] or not np.allclose(a[1:], b[1:], atol=tol) for a, b in zip(one.atoms, other.atoms, strict=True)):
        out.append("atoms")
    return out


def merge_phases(phases: Sequence[Phase]) -> tuple[dict[int, Phase], dict[int, int]]:
    """(phases by new id, new id of each map): equal phases become one, and a different phase of the same name gets its
    map's number behind it."""
    kept: dict[int, Phase] = {}
    new_id = {}
    for k, p in enumerate(phases):
        same = next((i for i, q in kept.items() if q.name == p.name), None)
        if same is not None and not different_in(p, kept[same]):
            new_id[k] = same
            continue
        kept[k] = p if same is None else Phase(f"{p.name}{k}", p.space_group, p.lattice, p.atoms)
        new_id[k] = k
    return kept, new_id


def _mean_of_best(scores: Column, n: int) -> Column:
    some = F.filter(F.slice(scores, 1, n), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))


def merge_crystal_maps(maps: Sequence[DataFrame], mean_n_best: int = 1, greater_is_better: bool = True, key: str = "idx", scores: str = "scores", indices: str = "simulation_indices") -> DataFrame:
    """One row per map point of any map: the key, phase_id, the winner's rotations, scores and simulation indices, and
    merged_scores and merged_simulation_indices of all maps, best first.

    A point's phase is the ordinal of the map with the best mean of its ``mean_n_best`` best scores, the first on a tie, or
    -1 if no map has it indexed (phase_id -1 in all). Merged scores with equal values come by rank, then by map. Indices are
    made unique: each map's are raised by one more than the distance between the greatest (raised) index of the map before
    and the least of its own. A point that a map lacks has no scores there.

    One shuffle by the key, of one row per map and point. Maps with indices are written to the shared folder first.
    """
    sign = 1.0 if greater_is_better else -1.0
    with_indices = all(indices in m.columns for m in maps)
    with_rotations = all("rotations" in m.columns for m in maps)
    raises = [0] * len(maps)
    if with_indices:
        # they are read twice: what made them, a search of a dictionary perhaps, runs once
        maps = [materialise(m, "map") for m in maps]
        ends = [m.agg(F.max(F.array_max(indices)), F.min(F.array_min(indices))) for m in maps]
        found = {r[0]: (r[1], r[2]) for r in _union([e.toDF("hi", "lo").select(F.lit(k).alias("k"), "hi", "lo") for k, e in enumerate(ends)]).collect()}
        for k in range(1, len(maps)):
            (hi, _), (_, lo) = found[k - 1], found[k]
            raises[k] = abs(hi + raises[k - 1] - lo) + 1 if hi is not None and lo is not None else raises[k - 1]
    rows = []
    for k, m in enumerate(maps):
        s = F.col(scores).cast("array<double>")
        i = F.col(indices).cast("array<bigint>") if with_indices else F.lit(None).cast("array<bigint>")
        each = F.transform(s, lambda v, n: F.struct((-sign * v).alias("order"), n.alias("n"), F.lit(k).alias("k"), v.alias("score"), (F.get(i, n) + raises[k]).alias("index")))  # noqa: B023
        mean = sign * _mean_of_best(s, mean_n_best)
        winner = F.struct(F.coalesce(mean, F.lit(float("-inf"))).alias("mean"), F.lit(-k).alias("first"))
        rotations = F.col("rotations") if with_rotations else F.lit(None).cast("array<double>")
        rows.append(m.select(key, winner.alias("w"), F.struct(rotations.alias("rotations"), s.alias("scores"), i.alias("indices")).alias("own"), each.alias("each"), (F.col("phase_id") != -1).alias("indexed")))
    merged = _union(rows).groupBy(key).agg(F.max("w").alias("w"), F.max_by("own", "w").alias("own"), F.array_sort(F.flatten(F.collect_list("each"))).alias("all"), F.max("indexed").alias("indexed"))
    out = [F.col(key), F.when(F.col("indexed"), -F.col("w.first")).otherwise(-1).alias("phase_id")]
    out += [F.col("own.rotations").alias("rotations")] * with_rotations
    out += [F.col("own.scores").alias(scores), F.transform("all", lambda e: e["score"]).alias(f"merged_{scores}")]
    if with_indices:
        out += [F.col("own.indices").alias(indices), F.transform("all", lambda e: e["index"]).alias(f"merged_{indices}")]
    return merged.select(*out)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def map_from_index_data(data: DataFrame, phase: str = "phase", quaternion: str = "quat") -> DataFrame:
    """A crystal map from indexing results (idx, phase, quat array, fit, cm, ...): phase_id and rotations, with the identity
    where nothing was indexed (phase -1)."""
    q = F.when(F.col(phase) == -1, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])).otherwise(F.col(quaternion).cast("array<double>"))
    rest = [c for c in data.columns if c not in (phase, quaternion)]
    return data.select(*rest, F.col(phase).cast("int").alias("phase_id"), F.array(F.struct(*[F.get(q, F.lit(k)).alias(n) for k, n in enumerate("abcd")])).alias("rotations"), F.lit(True).alias("is_in_data"))


def is_compatible(xmap: DataFrame, ny: int, nx: int) -> bool:
    """Whether a crystal map has the points of an ny x nx map."""
    ends = xmap.agg(F.max("y"), F.max("x"), F.min("y"), F.min("x"), F.count(F.lit(1))).first()
    return tuple(ends) == (ny - 1, nx - 1, 0, 0, ny * nx)
