"""EDAX patterns in UP1 (8-bit) and UP2 (16-bit) files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame

from scanloom.sources.files import Layout, PatternSource, open_file, write_records


def layout_of(path: str, nav_shape: tuple[int, int] | None = None) -> Layout:
    """Version 1 has no map shape; from version 3 on it has one and steps. Hexagonal grids become one row of points."""
    dtype = {"up1": "uint8", "up2": "uint16"}.get(path.rsplit(".", 1)[-1].lower())
    if dtype is None:
        raise ValueError("EDAX files end in .up1 or .up2")
    with open_file(path) as file:
        head, size = file.read(42), file.size()
    version, cols, rows, offset = struct.unpack_from("<4I", head)
    if version == 2:
        raise ValueError("files of version 1 or from 3 on can be read, not of version 2")
    there = (size - offset) // (rows * cols * (2 if dtype == "uint16" else 1))
    nx, ny, step, hexagonal = there, 1, (1.0, 1.0), False
    if version >= 3:
        nx, ny, hexagonal, dx, dy = struct.unpack_from("<II?dd", head, 17)
        nx, ny, step = (there, 1, (dy, dx)) if hexagonal else (nx, ny, (dy, dx))
    if nav_shape is not None and not hexagonal:
        if nav_shape[0] * nav_shape[1] != nx * ny:
            raise ValueError(f"a map of shape {nav_shape} doesn't have the {nx * ny} patterns of the file")
        ny, nx = nav_shape
    return Layout(nx * ny, nx, (rows, cols), dtype, offset, step=step, meta={"version": version, "hexagonal": hexagonal})


class EdaxSource(PatternSource):
    """Options: path, and ny and nx to give the map another shape of as many points."""

    @classmethod
    def name(cls) -> str:
        return "edax_up"

    def layout(self) -> Layout:
        shape = (int(self.options["ny"]), int(self.options["nx"])) if "ny" in self.options else None
        return layout_of(self.path, shape)


def write_edax(df: DataFrame, path: str, shape: tuple[int, int], nav_shape: tuple[int, int], step: tuple[float, float] = (1.0, 1.0)) -> int:
    """All patterns of ``df`` at their places in the map, with zeros where the map has none: a path in .up1 gives a file of
    version 1, one in .up2 a file of version 3, which has the map's shape and its steps (row, column)."""
    rows, cols = shape
    small = path.lower().endswith(".up1")
    head = struct.pack("<4I", 1, cols, rows, 16) if small else struct.pack("<4IBII?dd", 3, cols, rows, 42, 0, nav_shape[1], nav_shape[0], False, step[1], step[0])
    top, kind = (255, np.uint8) if small else (65535, "<u2")
    return write_records(df, path, head, lambda idx, y, x, pixels: np.clip(pixels, 0, top).astype(kind).tobytes(), n=nav_shape[0] * nav_shape[1], nx=nav_shape[1])
