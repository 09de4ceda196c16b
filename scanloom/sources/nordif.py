"""NORDIF acquisitions: raw 8-bit patterns one after the other, and a text file of settings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.sources.files import Layout, PatternSource, open_file, read_bytes, write_records
from scanloom.sources.images import read_bmp


@dataclass(frozen=True)
class Settings:
    values: dict[str, dict[str, str]]

    def get(self, block: str, label: str, default: str = "") -> str:
        return self.values.get(block.lower(), {}).get(label.lower(), default)

    def number(self, block: str, label: str, default: float = float("nan")) -> float:
        found = re.match(r"\s*[-+]?[\d.]+(?:[eE][-+]?\d+)?", self.get(block, label))
        return float(found[0]) if found else default

    def pair(self, block: str, label: str) -> tuple[int, int] | None:
        found = re.match(r"\s*(\d+)\s*x\s*(\d+)", self.get(block, label))
        return (int(found[1]), int(found[2])) if found else None

    @property
    def metadata(self) -> dict[str, object]:
        mic = "Microscope"
        maker = " ".join(v for v in (self.get(mic, "Manufacturer"), self.get(mic, "Model")) if v)
        return {"beam_energy": self.number(mic, "Accelerating voltage"), "magnification": self.number(mic, "Magnification"), "working_distance": self.number(mic, "Working distance"), "microscope": maker}

    def detector(self, kind: str = "Acquisition") -> dict[str, object]:
        width, height = self.pair(f"{kind} settings", "Resolution") or (0, 0)
        return {
            "shape": (height, width), "sample_tilt": self.number("Microscope", "Tilt angle", 70.0),
            "tilt": 0.0 - self.number("Detector angles", "Elevation", 0.0), "azimuthal": self.number("Detector angles", "Azimuthal", 0.0),
        }

    @property
    def map_shape(self) -> tuple[int, int] | None:
        """(ny, nx)."""
        return self.pair("Area", "Number of samples")

    @property
    def step_size(self) -> float:
        return self.number("Area", "Step size", 1.0)

    def calibration(self) -> list[tuple[int, int]]:
        """Map points (y, x) of the calibration patterns, in map steps from the area's top left corner."""
        top, left = self.number("Area", "Top", 0.0), self.number("Area", "Left", 0.0)
        scale = self.step_size / self.number("Electron image", "Pixel size", self.step_size)
        points = [re.match(r"\s*(\d+)\s*,\s*(\d+)", v) for k, v in sorted(self.values.get("calibration patterns", {}).items()) if k.startswith("calibration (")]
        return [(round((int(m[2]) - top) / scale), round((int(m[1]) - left) / scale)) for m in points if m]


def parse_settings(text: str) -> Settings:
    """Blocks of lines "[name]", then "label<tab>value<tab>unit"."""
    out: dict[str, dict[str, str]] = {}
    block: dict[str, str] = {}
    for line in text.splitlines():
        if head := re.match(r"\s*\[(.+?)\]", line):
            block = out.setdefault(head[1].strip().lower(), {})
        elif "\t" in line:
            label, _, rest = line.partition("\t")
            value = rest.split("\t")[0].strip()
            if point := re.match(r"Calibration\s*\((\d+),\s*(\d+)\)", label.strip()):
                value = f"{point[1]},{point[2]}"
            block.setdefault(label.strip().lower(), value)
    return Settings(out)


def read_settings(path: str) -> Settings:
    return parse_settings(read_bytes(path).decode("latin-1"))


class NordifSource(PatternSource):
    """Options: path, and settings (a path) or ny, nx, rows, cols. A file that is too short is filled up with zeros."""

    @classmethod
    def name(cls) -> str:
        return "nordif"

    def layout(self) -> Layout:
        own = {k: self.options.get(k) for k in ("ny", "nx", "rows", "cols")}
        step = 1.0
        if "settings" in self.options:
            s = read_settings(self.options["settings"])
            ny, nx = s.map_shape or (None, None)
            rows, cols = s.detector()["shape"]
            found = {"ny": ny, "nx": nx, "rows": rows, "cols": cols}
            own = {k: v if v is not None else found[k] for k, v in own.items()}
            step = s.step_size
        if any(v is None for v in own.values()):
            raise ValueError("without a settings file ny, nx, rows and cols must be given")
        ny, nx, rows, cols = (int(own[k]) for k in ("ny", "nx", "rows", "cols"))
        return Layout(ny * nx, nx, (rows, cols), "uint8", step=(step, step))


def static_background(folder: str) -> np.ndarray | None:
    """The background pattern beside an acquisition, if there is one."""
    try:
        return read_bmp(read_bytes(f"{folder}/Background acquisition pattern.bmp"))
    except FileNotFoundError:
        return None


def calibration_patterns(df_files: DataFrame) -> DataFrame:
    """(idx, beam_y, beam_x, rows, cols, pixels) from a ``binaryFile`` table of "Calibration (x,y).bmp" files."""
    from scanloom.sources.images import decode_files

    at = [F.regexp_extract("path", r"Calibration[ %20]*\((\d+),(\d+)\)\.bmp$", k).cast("int") for k in (1, 2)]
    named = df_files.select("path", "content", at[1].alias("beam_y"), at[0].alias("beam_x")).filter("beam_y is not null")
    return decode_files(named)


def write_nordif(df: DataFrame, path: str, column: str = "pixels", nav_shape: tuple[int, int] | None = None) -> int:
    """All patterns of ``df`` in the order of idx as one raw 8-bit file; the number of bytes. With ``nav_shape`` they are at
    their places in the map, with zeros where it has none."""
    n, nx = (None, None) if nav_shape is None else (nav_shape[0] * nav_shape[1], nav_shape[1])
    return write_records(df, path, b"", lambda idx, y, x, pixels: np.clip(pixels, 0, 255).astype(np.uint8).tobytes(), column, n, nx)


__all__ = ["NordifSource", "Settings", "calibration_patterns", "open_file", "parse_settings", "read_settings", "static_background", "write_nordif"]
