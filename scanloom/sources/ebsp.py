"""Oxford Instruments patterns in .ebsp files, uncompressed, of versions 0 to 5."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame

from scanloom.sources.files import Layout, PatternSource, open_file, write_records

#: Offsets read at once.
AT_ONCE = 1 << 20
_MOST = int(np.iinfo(np.int64).max)


def _header(version: int) -> str:
    """(map x, map y from version 5 on) is compressed, rows, columns, bytes."""
    return "<6i" if version >= 5 else "<4i"


def count_patterns(offsets: np.ndarray, table_at: int, least: int = _MOST) -> tuple[int, int]:
    """How many of the numbers read as offsets are offsets, and the least of those. The first pattern lies right behind the
    table, so the table's end is the least offset that isn't 0 and lies behind the numbers that led to it. ``table_at`` is
    where the first of the numbers stands, ``least`` the least offset before it."""
    v = np.where(offsets == 0, _MOST, offsets)
    before = np.minimum.accumulate(np.concatenate([[least], v]))
    here = table_at + 8 * np.arange(len(v), dtype=np.int64)
    ends = (here >= before[:-1]) | ((offsets != 0) & (v < here + 8))
    n = int(ends.argmax()) if ends.any() else len(v)
    return n, int(before[n])


def read_offsets(file, table_at: int, size: int) -> np.ndarray:
    """The whole table of offsets, AT_ONCE of them at a time."""
    parts, least, at = [], _MOST, table_at
    while at < size:
        file.seek(at)
        raw = file.read(8 * min(AT_ONCE, (size - at) // 8))
        if not raw:
            break
        some = np.frombuffer(raw, "<i8")
        n, least = count_patterns(some, at, least)
        parts.append(some[:n])
        at += 8 * n
        if n < len(some):
            break
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def layout_of(path: str) -> Layout:
    """Patterns in the order of the map, whose last row may be incomplete. A file in which some are absent, or without beam
    positions, is one row of points, without the absent ones."""
    with open_file(path) as file:
        size = file.size()
        (first,) = struct.unpack("<q", file.read(8))
        version = -first if first < 0 else 0
        table_at = 0 if version == 0 else 9 if version > 3 else 8
        head = _header(version)
        offsets = read_offsets(file, table_at, size)
        n = len(offsets)
        there = offsets[offsets != 0]
        if not len(there):
            raise ValueError("a file without patterns")

        def at(position: int) -> tuple[int, int, int, int]:
            file.seek(int(position))
            return struct.unpack(head, file.read(struct.calcsize(head)))[-4:]

        compressed, rows, cols, n_bytes = at(there.min())
        if compressed:
            raise NotImplementedError("compressed patterns can't be read")
        dtype = "uint8" if n_bytes == rows * cols else "uint16"

        def beam(position: int) -> tuple[float, float] | None:
            """The position of the beam behind a pattern, if it is there: (x, y)."""
            file.seek(int(position) + struct.calcsize(head) + n_bytes)
            raw = file.read(18)
            if version == 1:
                return struct.unpack_from("<dd", raw)
            if version > 1 and len(raw) == 18 and raw[0] and raw[9]:
                return struct.unpack_from("<d", raw, 1)[0], struct.unpack_from("<d", raw, 10)[0]
            return None

        nx, step, whole, last = len(there), (1.0, 1.0), len(there) == n, len(there) - 1
        places = [beam(p) for p in (there[0], there[min(1, last)], there[-1])] if whole else [None]
        if all(p is not None for p in places) and len(there) > 1:
            dx = places[1][0] - places[0][0]
            if dx:
                across, down = (int(abs(round(places[2][k] / dx) - round(places[0][k] / dx))) for k in (0, 1))
                if not down or (last - across) % down == 0:  # the last pattern's place is down * nx + across; its row may be incomplete
                    width = (last - across) // down if down else n
                    ends = [beam(there[k]) for k in (width - 1, width)] if down and 0 < across + 1 <= width else []
                    turns = [tuple(int(abs(round(p[k] / dx) - round(places[0][k] / dx))) for k in (0, 1)) for p in ends if p is not None]
                    if not down and across == last or turns == [(width - 1, 0), (0, 1)]:
                        nx, step = width, (abs(dx), abs(dx))
    positions = (offsets if whole else there) + struct.calcsize(head)
    return Layout(len(positions), nx, (rows, cols), dtype, positions=positions, step=step, meta={"version": version, "map_index": np.flatnonzero(offsets)})


class EbspSource(PatternSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "oxford_ebsp"

    def layout(self) -> Layout:
        return layout_of(self.path)


def write_ebsp(df: DataFrame, path: str, shape: tuple[int, int], n: int, step: float = 1.0, dtype: str = "uint8") -> int:
    """All n patterns of ``df`` in the order of idx as a file of version 5, with the place of each in the map and that of
    the beam."""
    rows, cols = shape
    kind = np.dtype([("place", "<i4", 2), ("head", "<i4", 4), ("pixels", np.dtype(dtype).newbyteorder("<"), rows * cols), ("has_x", "u1"), ("beam_x", "<f8"), ("has_y", "u1"), ("beam_y", "<f8")])
    at = 9 + 8 * n
    head = struct.pack("<qB", -5, 0) + (at + kind.itemsize * np.arange(n, dtype="<i8")).tobytes()
    most = np.iinfo(dtype).max

    def record(idx: np.ndarray, y: np.ndarray, x: np.ndarray, pixels: np.ndarray) -> bytes:
        out = np.zeros(len(idx), kind)
        out["place"][:, 0], out["place"][:, 1] = x, y
        out["head"] = 0, rows, cols, rows * cols * np.dtype(dtype).itemsize
        out["pixels"] = np.clip(pixels, 0, most)
        out["has_x"], out["has_y"], out["beam_x"], out["beam_y"] = 1, 1, x * step, y * step
        return out.tobytes()

    return write_records(df, path, head, record)
