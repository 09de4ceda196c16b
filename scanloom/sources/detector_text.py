"""Detectors in text files: a header of "# key: value" lines, then one projection centre per line."""

from __future__ import annotations

import re
from datetime import datetime, timezone

import numpy as np
import pyarrow.fs as pafs

from scanloom.operators.detector import Detector
from scanloom.sources.files import read_bytes

_NUMBERS = ("px_size", "binning", "tilt", "azimuthal", "twist", "sample_tilt")


def _shape(text: str) -> tuple[int, ...]:
    return tuple(int(v) for v in re.findall(r"\d+", text))


def parse_detector(text: str) -> Detector:
    found = dict(re.findall(r"^#\s*(\w+):\s*(.+?)\s*$", text, re.M))
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    pc = np.array(rows, float)
    nav = _shape(found.get("navigation_shape", ""))
    numbers = {k: float(m[0]) for k in _NUMBERS if (m := re.match(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", found.get(k, "")))}
    if "binning" in numbers:
        numbers["binning"] = int(numbers["binning"])
    return Detector(shape=_shape(found["shape"]), pc=pc.reshape(*nav, 3) if nav else pc, convention=found.get("convention", "bruker"), **numbers)


def format_detector(detector: Detector, convention: str = "bruker") -> str:
    head = ["Detector", f"  shape: {tuple(detector.shape)}", f"  px_size: {detector.px_size}", f"  binning: {detector.binning}"]
    head += [f"  {k}: {getattr(detector, k)} deg" for k in ("tilt", "azimuthal", "twist", "sample_tilt")]
    head += [f"  convention: {convention}", f"  navigation_shape: {tuple(detector.navigation_shape)}", "", f"Time: {datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S}", "", "Column names: PCx, PCy, PCz"]
    return "\n".join([f"# {line}" for line in head] + [" ".join(f"{v:.7f}" for v in p) for p in detector.pc_in(convention).reshape(-1, 3)]) + "\n"


def load_detector(path: str) -> Detector:
    return parse_detector(read_bytes(path).decode())


def save_detector(detector: Detector, path: str, convention: str = "bruker") -> None:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_output_stream(at) as out:
        out.write(format_detector(detector, convention).encode())
