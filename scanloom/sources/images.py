"""Greyscale images: 8-bit BMP, PNG of 8 or 16 bits, uncompressed TIFF; and folders of them, one pattern each."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from scanloom.storage import bounded_batches


def read_bmp(raw: bytes) -> np.ndarray:
    if raw[:2] != b"BM":
        raise ValueError("not a BMP file")
    at, header, width, height, _, bits, compression = struct.unpack_from("<IIiiHHI", raw, 10)
    if bits not in (8, 24) or compression:
        raise ValueError("only uncompressed BMP files of 8 or 24 bits can be read")
    n = bits // 8
    stride = (width * n + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, abs(height) * stride, at).reshape(abs(height), stride)[:, : width * n]
    rows = rows[::-1] if height > 0 else rows
    if n == 3:
        return rows.reshape(abs(height), width, 3)[..., 1].copy()
    palette = np.frombuffer(raw, np.uint8, min(1024, at - 14 - header), 14 + header).reshape(-1, 4)
    return palette[rows, 1] if len(palette) else rows.copy()


def write_bmp(image: np.ndarray) -> bytes:
    rows, cols = image.shape
    stride = (cols + 3) // 4 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, :cols] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy()
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    return b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, cols, rows, 1, 8, 0, body.size, 0, 0, 256, 0) + palette.tobytes() + body.tobytes()


def write_png(image: np.ndarray) -> bytes:
    """Of 8 or 16 bits, as the image."""
    rows, cols = image.shape
    bits = 8 * image.dtype.itemsize
    lines = np.zeros((rows, 1 + cols * bits // 8), np.uint8)
    lines[:, 1:] = image.astype(f">u{bits // 8}").view(np.uint8).reshape(rows, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data = 8, []
    width = height = bits = 0
    while at < len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if colour or interlaced or bits not in (8, 16):
                raise ValueError("only greyscale PNG files of 8 or 16 bits without interlacing can be read")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    n = bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.int64)
    for r in range(height):
        line, kind = rows[r, 1:].astype(np.int64), rows[r, 0]
        if kind == 2:
            line = line + above
        elif kind:
            for i in range(len(line)):
                a = line[i - n] if i >= n else 0
                b, c = above[i], above[i - n] if i >= n else 0
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[i] = (line[i] + add) & 255
        above = line & 255
        out[r] = above
    return out if n == 1 else out.view(">u2").astype(np.uint16)


def read_tiff(raw: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    (n,) = struct.unpack_from(order + "H", raw, at)
    tags = {}
    sizes = {1: "B", 3: "H", 4: "I"}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind in sizes:
            place = at + 2 + 12 * k + 8
            if struct.calcsize(sizes[kind]) * count > 4:
                (place,) = struct.unpack_from(order + "I", raw, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{sizes[kind]}", raw, place)
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("only uncompressed greyscale TIFF files can be read")
    kind = {8: "u1", 16: "u2", 32: "u4"}[tags.get(258, (8,))[0]]
    data = b"".join(raw[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(data, order + kind).reshape(tags[257][0], tags[256][0]).astype(kind)


READERS = {"bmp": read_bmp, "png": read_png, "tif": read_tiff, "tiff": read_tiff}


def decode(name: str, raw: bytes) -> np.ndarray:
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"images of type {suffix!r} can't be read, only {sorted(READERS)}")
    return READERS[suffix](raw)


def decode_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content and others) with rows, cols and pixels for path and content; each task decodes its own."""
    bounded_batches(files.sparkSession, 200)
    kept = [f for f in files.schema if f.name not in ("path", "content")]
    schema = StructType([*kept, StructField("rows", IntegerType()), StructField("cols", IntegerType()), StructField("pixels", ArrayType(IntegerType()))])

    def run(batches):
        for b in batches:
            found = [decode(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            made = [pa.array([i.shape[k] for i in found], pa.int32()) for k in (0, 1)] + [pa.array([i.ravel().astype(np.int32) for i in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *made], [f.name for f in schema])

    return files.mapInArrow(run, schema)


#: Map coordinates in file names: "..._x3y5.bmp" and "...-5-3.bmp" (row, column).
XY_NAME, RC_NAME = r"_x(\d+)y(\d+)\.[A-Za-z]+$", r"-(\d+)-(\d+)\.[A-Za-z]+$"


def read_directory(spark: SparkSession, path: str, pattern: str | None = None, glob: str = "*") -> DataFrame:
    """(idx, y, x, rows, cols, pixels) from a folder of images. ``pattern`` has two groups, x and y; by default file names
    tell the coordinates, and if they don't, files in the order of their names lie in one row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    if pattern:
        xy = [F.regexp_extract("path", pattern, k) for k in (1, 2)]
    else:
        first, second = ([F.regexp_extract("path", p, k) for k in g] for p, g in ((XY_NAME, (1, 2)), (RC_NAME, (2, 1))))
        xy = [F.when(a != "", a).otherwise(b) for a, b in zip(first, second, strict=True)]
    named = files.withColumns({"x": xy[0], "y": xy[1]})
    if named.filter("x = '' or y = ''").isEmpty():
        named = named.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})
        width = named.agg(F.max("x") + 1).first()[0]
        named = named.withColumn("idx", F.col("y").cast("bigint") * width + F.col("x"))
    else:
        # names alone are put in order: file lists are small beside the files
        names = sorted(r[0] for r in files.select("path").collect())
        order = spark.createDataFrame(list(enumerate(names)), "idx bigint, path string")
        named = files.join(order, "path").withColumns({"y": F.lit(0), "x": F.col("idx").cast("int")})
    return decode_files(named.select("idx", "y", "x", "path", "content"))


def write_directory(df: DataFrame, path: str, shape: tuple[int, int], suffix: str = "png", name: str = "pattern_x{x}y{y}", column: str = "pixels") -> int:
    """One 8-bit image per pattern, named after its map point, written by the tasks; the number of files. A file that is
    there is replaced, so a task may run again."""
    writer = {"png": write_png, "bmp": write_bmp}[suffix]
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    fs.create_dir(at)

    def run(batches):
        store, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        for b in batches:
            block = np.clip(b.column(2).flatten().to_numpy(zero_copy_only=False), 0, 255).astype(np.uint8).reshape(-1, *shape)
            for y, x, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), block, strict=True):
                with store.open_output_stream(f"{where}/{name.format(y=y, x=x)}.{suffix}") as out:
                    out.write(writer(image))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    made = df.select("y", "x", column).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]
    return int(made or 0)
