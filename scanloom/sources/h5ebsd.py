"""Scans and master patterns in HDF5 files: an own layout, those of three makers of detectors, and simulated ones.

A file's headers are read by the driver, its patterns by tasks: in ranges of patterns if they are stored in one piece, in
ranges of chunks otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scanloom.operators.detector import Detector
from scanloom.operators.master_pattern import MASTER_BYTES, MasterPattern
from scanloom.sources import hdf5
from scanloom.sources.files import PARTITION_BYTES, Layout, PatternReader, PatternSource, element_of, open_file, write_records

#: Fixed names of datasets: where patterns are, and what a header calls map rows, columns, pattern rows, columns and steps.
LAYOUTS = {
    "own": ("EBSD/Data", ("patterns",), ("n_rows", "n_columns", "pattern_height", "pattern_width", "step_y", "step_x")),
    "bruker": ("EBSD/Data", ("RawPatterns",), ("NROWS", "NCOLS", "PatternHeight", "PatternWidth", "YSTEP", "XSTEP")),
    "edax": ("EBSD/Data", ("Pattern",), ("nRows", "nColumns", "Pattern Height", "Pattern Width", "Step Y", "Step X")),
    "oxford": ("EBSD/Data", ("Processed Patterns", "Unprocessed Patterns"), ("Y Cells", "X Cells", "Pattern Height", "Pattern Width", "Y Step", "X Step")),
}
EMSOFT_PATTERNS = "EMData/EBSD/EBSDPatterns"
#: By projection, the upper and the lower hemisphere of a simulated master pattern.
EMSOFT_MASTERS = {"lambert": ("mLPNH", "mLPSH"), "stereographic": ("masterSPNH", "masterSPSH")}


@dataclass
class Found:
    """What is known of a scan before its patterns are read. order: the map's index of each stored pattern."""

    layout: Layout
    data: hdf5.Dataset
    kind: str = "own"
    detector: Detector | None = None
    static_background: np.ndarray | None = None
    header: dict = field(default_factory=dict)
    angles: np.ndarray | None = None
    order: np.ndarray | None = None


def scan_names(path: str) -> list[str]:
    """Groups of a file that have scans."""
    with open_file(path) as raw:
        file = hdf5.File(raw)
        return [n for n, at in file.members(file.root).items() if file.dataset(at) is None and "EBSD" in file.members(at)]


def binning_of(camera_mode: str) -> int | None:
    """From the pattern's height in a camera's mode, "2x2 (622x512 px)"; 1024 is unbinned, and modes of 88 rows leave some out."""
    found = re.search(r"\((\d+)x(\d+) px\)", camera_mode or "")
    return None if found is None else 8 if found[2] == "88" else int(round(1024 / int(found[2])))


def find(path: str, scan: str | None = None) -> Found:
    """A scan of a file, by default its first."""
    with open_file(path) as raw:
        file = hdf5.File(raw)
        if file.address(EMSOFT_PATTERNS) is not None:
            return _simulated(file)
        root = {n: file.value(d) for n, at in file.members(file.root).items() if (d := file.dataset(at)) is not None}
        maker = str(root.get("Manufacturer", root.get("manufacturer", ""))).lower()
        kind = next((k for k in LAYOUTS if k in maker), "own")
        names = [n for n, at in file.members(file.root).items() if file.dataset(at) is None and "EBSD" in file.members(at)]
        if not names or (scan is not None and scan not in names):
            raise ValueError(f"the file has no scan {scan!r}, but {names}")
        group = scan or names[0]
        folder, possible, keys = LAYOUTS[kind]
        header, data = file.read(f"{group}/EBSD/Header"), file.read(f"{group}/{folder}", possible)
        stored = next((data[n] for n in possible if n in data), None)
        if stored is None:
            raise ValueError(f"none of {possible} is in the scan")
        ny, nx, sy, sx = (int(header[k]) for k in keys[:4])
        step = tuple(float(header.get(k, 1)) for k in keys[4:])
        grid = header.get("Grid Type")
        if grid is not None and grid not in ("isometric", "SqrGrid"):
            raise ValueError(f"only square grids can be read, not {grid!r}")
        order = None
        if kind == "bruker" and (sem := file.address(f"{group}/EBSD/SEM")) is not None:
            where = file._read(sem, ())
            iy, ix = (np.asarray(where[k]).ravel() - np.min(where[k]) for k in ("IY", "IX"))
            ny, nx = int(iy.max()) + 1, int(ix.max()) + 1
            if ny * nx != len(iy):
                raise ValueError("only a rectangular region of interest can be read")
            order = iy * nx + ix
        detector, background = _detector(kind, header, data, (ny, nx), (sy, sx), root)
        return Found(_layout(stored, ny * nx, nx, (sy, sx), step, order), stored, kind, detector, background, header, order=order)


def _layout(stored: hdf5.Dataset, n: int, nx: int, shape: tuple[int, int], step: tuple[float, float], order: np.ndarray | None = None) -> Layout:
    if stored.dtype is None or stored.dtype.kind not in "uif":
        raise ValueError("patterns must be numbers")
    return Layout(n, nx, shape, stored.dtype.str, offset=stored.address or 0, step=step)


def _detector(kind: str, header: dict, data: dict, nav: tuple[int, int], shape: tuple[int, int], root: dict) -> tuple[Detector, np.ndarray | None]:
    def centres(x, y, z) -> np.ndarray:
        pc = np.column_stack([np.ravel(v).astype(float) for v in np.broadcast_arrays(x, y, z)])
        return pc.reshape(*nav, 3) if len(pc) == nav[0] * nav[1] > 1 else pc[:1]

    get = header.get
    if kind == "bruker":
        px = get("DetectorFullHeightMicrons", 1) / get("UnClippedPatternHeight", 1)
        pc = centres(data.get("PCX", 0.5), data.get("PCY", 0.5), data.get("DD", 0.5))
        return Detector(shape, float(px), tilt=float(get("CameraTilt", 0.0)), sample_tilt=float(get("Sample Tilt", 0.0)), pc=pc), get("StaticBackground")
    if kind == "edax":
        own = get("Pattern Center Calibration", {})
        pc = centres(own.get("x-star", 0.5), own.get("y-star", 0.5), own.get("z-star", 0.5))
        return Detector(shape, tilt=float(get("Camera Elevation Angle", 0.0)), azimuthal=float(get("Camera Azimuthal Angle", 0.0)), sample_tilt=float(get("Sample Tilt", 70.0)), pc=pc, convention="tsl"), None
    if kind == "oxford":
        new = int(str(root.get("Format Version", "0")).split(".")[0] or 0) >= 7
        turned = get("Detector Orientation Euler")
        pc = centres(data.get("Pattern Center X", 0.5), data.get("Pattern Center Y", 0.5), data.get("Detector Distance", 0.5))
        tilt = float(np.rad2deg(turned[1]) - 90) if turned is not None and np.size(turned) > 1 else 0.0
        binning = binning_of(get("Camera Mode" if new else "Camera Binning Mode", ""))
        return Detector(shape, binning=binning or 1, tilt=tilt, sample_tilt=float(np.rad2deg(get("Tilt Angle", np.deg2rad(70)))), pc=pc, convention="oxford"), get("Processed Static Background")
    pc = centres(get("pcx", 0.5), get("pcy", 0.5), get("pcz", 0.5))
    angles = {k: float(get(n, v)) for k, n, v in (("tilt", "elevation_angle", 0.0), ("azimuthal", "azimuth_angle", 0.0), ("twist", "twist_angle", 0.0), ("sample_tilt", "sample_tilt", 70.0))}
    return Detector(shape, float(get("detector_pixel_size", 1)), int(get("binning", 1)), pc=pc, **angles), get("static_background")


def _simulated(file: hdf5.File) -> Found:
    names = file.read("NMLparameters/EBSDNameList")
    stored = file.dataset(file.address(EMSOFT_PATTERNS))
    n = int(np.prod(stored.shape[:-2]))
    at = file.address("EMData/EBSD/EulerAngles")
    angles = None if at is None else np.asarray(file.value(file.dataset(at)), float).reshape(-1, 3)
    layout = _layout(stored, n, n, (int(names["numsy"]), int(names["numsx"])), (1.0, 1.0))
    return Found(layout, stored, "emsoft", header=names, angles=angles)


class Chunks(InputPartition):
    def __init__(self, k: int, chunks: list[tuple[tuple[int, ...], int, int, int]]):
        super().__init__(k)
        self.chunks = chunks


class ChunkReader(DataSourceReader):
    """Patterns in chunks; a task reads and decompresses its own."""

    def __init__(self, path: str, found: Found):
        data = found.data
        if tuple(data.chunk[-2:]) != tuple(data.shape[-2:]):
            raise NotImplementedError("chunks with parts of patterns can't be read")
        self.path, self.found = path, found

    def partitions(self) -> list[Chunks]:
        one = max(1, int(np.prod(self.found.data.chunk)) * self.found.data.dtype.itemsize)
        step = max(1, PARTITION_BYTES // one)
        own = self.found.data.chunks
        return [Chunks(a, own[a : a + step]) for a in range(0, len(own), step)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        data, nx, order = self.found.data, self.found.layout.nx, self.found.order
        kind = element_of(data.dtype.str)[1]
        lead = data.shape[:-2]
        with open_file(self.path) as file:
            for place, at, size, skipped in partition.chunks:
                file.seek(at)
                block = np.frombuffer(data.unfiltered(file.read(size), skipped), data.dtype).reshape(*data.chunk[:-2], -1)
                inside = tuple(slice(0, min(c, s - p)) for p, c, s in zip(place, data.chunk[:-2], lead, strict=False))
                where = np.meshgrid(*[np.arange(p, min(p + c, s)) for p, c, s in zip(place, data.chunk[:-2], lead, strict=False)], indexing="ij")
                idx = np.ravel_multi_index([w.ravel() for w in where], lead)
                idx = idx if order is None else order[idx]
                values = np.ascontiguousarray(block[inside]).reshape(len(idx), -1)
                pixels = pa.ListArray.from_arrays(pa.array(np.arange(len(idx) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel().astype(data.dtype.newbyteorder("="))).cast(kind))
                yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array((idx // nx).astype(np.int32)), pa.array((idx % nx).astype(np.int32)), pixels], ["idx", "y", "x", "pixels"])


class OrderedReader(PatternReader):
    """Patterns in one piece whose order isn't that of the map."""

    def __init__(self, path: str, found: Found):
        super().__init__(path, found.layout)
        self.order = found.order

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for b in super().read(partition):
            idx = self.order[b.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array((idx // self.layout.nx).astype(np.int32)), pa.array((idx % self.layout.nx).astype(np.int32)), b.column(3)], b.schema.names)


class H5Source(PatternSource):
    """Options: path, and scan, the name of the scan's group."""

    @classmethod
    def name(cls) -> str:
        return "h5ebsd"

    def layout(self) -> Layout:
        return find(self.path, self.options.get("scan")).layout

    def reader(self, schema: StructType) -> DataSourceReader:
        found = find(self.path, self.options.get("scan"))
        if found.data.chunk is not None:
            return ChunkReader(self.path, found)
        return PatternReader(self.path, found.layout) if found.order is None else OrderedReader(self.path, found)


def write_h5(df: DataFrame, path: str, shape: tuple[int, int], nav_shape: tuple[int, int], dtype: str = "uint8", detector: Detector | None = None, step: tuple[float, float] = (1.0, 1.0), static_background: np.ndarray | None = None, scan: str = "Scan 1") -> int:
    """A file of the own layout with one scan; patterns come last and are written by the tasks, with zeros at points of the
    map that have none."""
    d = detector or Detector(shape)
    header = {
        "n_rows": nav_shape[0], "n_columns": nav_shape[1], "pattern_height": shape[0], "pattern_width": shape[1], "step_y": float(step[0]), "step_x": float(step[1]),
        "detector_pixel_size": float(d.px_size), "binning": int(d.binning), "elevation_angle": float(d.tilt), "azimuth_angle": float(d.azimuthal), "twist_angle": float(d.twist), "sample_tilt": float(d.sample_tilt),
        "pcx": np.asarray(d.pcx, float), "pcy": np.asarray(d.pcy, float), "pcz": np.asarray(d.pcz, float),
    }
    if static_background is not None:
        header["static_background"] = np.asarray(static_background).reshape(shape)
    tree = {"manufacturer": "scanloom", "version": "0.1.0", scan: {"EBSD": {"Header": header, "Data": {"patterns": hdf5.Later((*nav_shape, *shape), dtype)}}, "SEM": {"Header": {"microscope": ""}}}}
    return write_tree(df, path, tree, dtype, nav_shape[0] * nav_shape[1], nav_shape[1])


def write_tree(df: DataFrame, path: str, tree: dict, dtype: str, n: int | None = None, nx: int | None = None) -> int:
    """A file of ``tree`` with the patterns of ``df`` as what is written later; n and nx: see ``write_records``."""
    kind = np.dtype(dtype)
    ends = (np.iinfo(kind).min, np.iinfo(kind).max) if kind.kind in "iu" else (-np.inf, np.inf)
    return write_records(df, path, hdf5.file_bytes(tree), lambda idx, y, x, pixels: np.clip(pixels, *ends).astype(kind).tobytes(), n=n, nx=nx)


def read_master_pattern(path: str, projection: str = "stereographic", hemisphere: str = "upper", energy: tuple[float, float] | None = None, kind: str = "EBSD") -> MasterPattern:
    """A simulated master pattern: of both hemispheres, or of one, at all energies or those of a range. kind: EBSD, TKD or ECP.

    Lambert patterns are summed over the atoms' sites. A file whose patterns take more than MASTER_BYTES is refused.
    """
    with open_file(path) as raw:
        file = hdf5.File(raw)
        folder = f"EMData/{kind}master"
        names = dict(zip(("upper", "lower"), EMSOFT_MASTERS[projection], strict=True))
        energies = np.atleast_1d(file.value(file.dataset(file.address(f"{folder}/{'EkeV' if kind == 'ECP' else 'EkeVs'}")))).astype(float)
        keep = np.ones(len(energies), bool) if energy is None else (energies >= energy[0]) & (energies <= energy[1])
        out = {}
        for half in ("upper", "lower") if hemisphere == "both" else (hemisphere,):
            at = file.address(f"{folder}/{names[half]}")
            if at is None:
                raise ValueError(f"the file has no {half} hemisphere in the {projection} projection")
            d = file.dataset(at)
            if d.n_bytes > MASTER_BYTES:
                raise ValueError(f"a master pattern of {d.n_bytes} bytes is too large")
            v = np.asarray(file.value(d), float).reshape(d.shape)
            v = v.sum(axis=0) if projection == "lambert" and kind != "ECP" else v[..., ::-1, :] if projection == "stereographic" else v
            out[half] = v.reshape(-1, *v.shape[-2:])[keep]
        phase = file.address("CrystalData")
        title = "" if phase is None else str(file._read(phase, ()).get("Source", ""))
        return MasterPattern(out.get("upper"), out.get("lower"), projection, tuple(energies[keep]), phase=title, kind=kind)
