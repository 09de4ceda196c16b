"""Files written here and read back, the store of scans, and streams."""

import io
import struct
import zlib

import numpy as np
import pytest

from scanloom import streaming
from scanloom.operators.detector import Detector
from scanloom.scan import Scan
from scanloom.sources import detector_text, ebsp, h5ebsd, hdf5, images, load, nordif, save, store

RNG = np.random.default_rng(4)


def read(scan):
    return np.array([r["pixels"] for r in scan.df.orderBy("idx").collect()])


def test_up1(spark, tmp_path):
    data = RNG.integers(0, 256, (7, 4 * 5)).astype(np.uint8)
    (tmp_path / "a.up1").write_bytes(struct.pack("<4I", 1, 5, 4, 16) + data.tobytes())
    scan = load(spark, str(tmp_path / "a.up1"))
    assert scan.shape == (4, 5) and scan.map_shape() == (1, 7)
    assert (read(scan) == data).all()


@pytest.mark.parametrize("hexagonal", [False, True])
def test_up2(spark, tmp_path, hexagonal):
    data = RNG.integers(0, 65536, (6, 4 * 5)).astype(np.uint16)
    (tmp_path / "a.up2").write_bytes(struct.pack("<4IBII?dd", 3, 5, 4, 42, 0, 3, 2, hexagonal, 0.5, 0.25) + data.tobytes())
    scan = load(spark, str(tmp_path / "a.up2"))
    assert scan.map_shape() == ((1, 6) if hexagonal else (2, 3)) and (read(scan) == data).all()
    if not hexagonal:
        assert scan.step == (0.25, 0.5) and load(spark, str(tmp_path / "a.up2"), ny=3, nx=2).map_shape() == (3, 2)
        with pytest.raises(ValueError, match="map of shape"):
            load(spark, str(tmp_path / "a.up2"), ny=4, nx=2)
    (tmp_path / "b.up2").write_bytes(struct.pack("<4I", 2, 5, 4, 42))
    with pytest.raises(ValueError, match="version"):
        load(spark, str(tmp_path / "b.up2"))


def ebsp_bytes(version, data, order, absent=(), nx=2, compressed=0):
    n, (rows, cols) = len(data), data.shape[1:]
    head = (b"" if version == 0 else struct.pack("<q", -version)) + (b"\0" if version > 3 else b"")
    at, offsets, body = len(head) + 8 * n, [0] * n, b""
    for k in order:
        if k in absent:
            continue
        offsets[k] = at + len(body)
        body += (struct.pack("<ii", k % nx, k // nx) if version >= 5 else b"") + struct.pack("<4i", compressed, rows, cols, data[k].nbytes) + data[k].tobytes()
        x, y = struct.pack("<d", k % nx * 1.5), struct.pack("<d", k // nx * 1.5)
        body += x + y if version == 1 else b"\1" + x + b"\1" + y if version > 1 else b""
    return head + struct.pack(f"<{n}q", *offsets) + body


@pytest.mark.parametrize("version", [0, 1, 2, 4, 5])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_ebsp(spark, tmp_path, version, kind):
    data = RNG.integers(0, 256, (6, 8, 9)).astype(kind)
    path = tmp_path / "a.ebsp"
    path.write_bytes(ebsp_bytes(version, data, [0, 2, 1, 3, 5, 4]))
    scan = load(spark, str(path))
    assert (read(scan) == data.reshape(6, -1)).all()
    assert scan.map_shape() == ((3, 2) if version else (1, 6)) and scan.shape == (8, 9)
    path.write_bytes(ebsp_bytes(version, data, range(6), absent=(1, 4)))
    layout = ebsp.layout_of(str(path))
    assert layout.n == 4 and layout.meta["map_index"].tolist() == [0, 2, 3, 5]
    assert (read(load(spark, str(path))) == data[[0, 2, 3, 5]].reshape(4, -1)).all()
    path.write_bytes(ebsp_bytes(version, data, range(6), compressed=1))
    with pytest.raises(NotImplementedError):
        load(spark, str(path))


SETTINGS = "\n".join([
    "[Microscope]", "Manufacturer\tHitachi\t", "Model\tSU-6600\t", "Magnification\t200\t#", "Accelerating voltage\t20.0\tkV", "Working distance\t24.7\tmm", "Tilt angle\t70.0\t°",
    "[Detector angles]", "Azimuthal\t0.5\t°", "Elevation\t-2.0\t°", "[Acquisition settings]", "Resolution\t5x4\tpx", "[Area]", "Top\t89.2\tum", "Left\t60.0\tum", "Step size\t1.5\tum", "Number of samples\t2x3\t#",
    "[Calibration patterns]", "Calibration (120,100)\t\t",
])


def test_nordif(spark, tmp_path):
    data = RNG.integers(0, 256, (6, 20)).astype(np.uint8)
    (tmp_path / "Pattern.dat").write_bytes(data.tobytes()[:-7])
    (tmp_path / "Setting.txt").write_bytes(SETTINGS.encode("latin-1"))
    (tmp_path / "Background acquisition pattern.bmp").write_bytes(images.write_bmp(data[0].reshape(4, 5)))
    scan = load(spark, str(tmp_path / "Pattern.dat"), settings=str(tmp_path / "Setting.txt"))
    wanted = data.copy().ravel()
    wanted[-7:] = 0
    assert (read(scan).ravel() == wanted).all() and scan.map_shape() == (2, 3) and scan.step == (1.5, 1.5)
    assert (scan.static_background == data[0].reshape(4, 5)).all()
    assert scan.detector.tilt == 2 and scan.detector.azimuthal == 0.5 and scan.detector.sample_tilt == 70
    assert nordif.read_settings(str(tmp_path / "Setting.txt")).metadata["microscope"] == "Hitachi SU-6600"
    assert nordif.parse_settings(SETTINGS).calibration()
    save(scan, str(tmp_path / "out.dat"))
    assert (np.frombuffer((tmp_path / "out.dat").read_bytes(), np.uint8) == wanted).all()
    with pytest.raises(ValueError, match="settings"):
        load(spark, str(tmp_path / "Pattern.dat"))


def png(image):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + row.astype(image.dtype.newbyteorder(">")).tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8 * image.itemsize, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(image):
    tags = [(256, 3, image.shape[1]), (257, 3, image.shape[0]), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 200), (277, 3, 1), (278, 3, image.shape[0]), (279, 4, image.size)]
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    return head.ljust(200, b"\0") + image.tobytes()


@pytest.mark.parametrize("write", [("bmp", images.write_bmp), ("png", png), ("tif", tiff)])
def test_folders_of_images(spark, tmp_path, write):
    suffix, encode = write
    data = RNG.integers(0, 256, (6, 4, 5)).astype(np.uint8)
    for k in range(6):
        (tmp_path / f"pattern_x{k % 3}y{k // 3}.{suffix}").write_bytes(encode(data[k]))
    scan = load(spark, str(tmp_path), "images")
    assert scan.shape == (4, 5) and (read(scan) == data.reshape(6, -1)).all()
    assert scan.df.filter("idx = 4").select("y", "x").first() == (1, 1)


def test_a_detector_in_a_text_file(tmp_path):
    d = Detector((48, 60), 70.0, 4, 5.0, 1.0, 2.0, 70.0, RNG.uniform(0.3, 0.7, (2, 3, 3)))
    for convention in ("bruker", "tsl", "oxford", "emsoft"):
        detector_text.save_detector(d, str(tmp_path / "d.txt"), convention)
        back = detector_text.load_detector(str(tmp_path / "d.txt"))
        np.testing.assert_allclose(back.pc, d.pc, atol=1e-6)
        assert (back.shape, back.binning, back.tilt, back.azimuthal, back.twist) == (d.shape, 4, 5.0, 1.0, 2.0)


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(k, k // 2, k % 2, [k, 1, 2, 3]) for k in range(4)], "idx bigint, y int, x int, pixels array<smallint>")
    xmap = df.select("idx", "y", "x")
    scan = Scan(df, (2, 2), "uint8", (2, 2), Detector((2, 2), pc=[0.4, 0.5, 0.6]), np.array([1, 2, 3, 4]), xmap, (0.5, 0.5), "um", {"a": 1})
    path = str(tmp_path / "store")
    save(scan, path)
    store.write_scan(scan.crop(0, 1, 0, 2), path, "second")
    back, small = load(spark, path), load(spark, path, scan_id="second")
    assert back.df.count() == 4 and small.df.count() == 2 and back.metadata == {"a": 1} and back.xmap.count() == 4
    np.testing.assert_allclose(back.detector.pc, scan.detector.pc)
    assert back.remove_static_background().df.count() == 4
    with pytest.raises(ValueError, match="already"):
        save(scan, path)
    with pytest.raises(ValueError, match="no scan"):
        load(spark, path, scan_id="third")


def test_what_cant_be_read(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(b"no signature" * 20)
    with pytest.raises(ValueError, match="not an HDF5 file"):
        load(spark, str(tmp_path / "a.h5"))
    with pytest.raises(ValueError, match="format"):
        load(spark, str(tmp_path / "a.bin"), "unknown")


def test_quality_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from scanloom.operators.frequency import image_quality

    df = spark.range(40).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.array(*[F.rand(k) for k in range(9)]).alias("pixels"))
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_patterns(spark, str(tmp_path / "in"), df.schema)
    out = streaming.quality_by_window(stream, lambda d: image_quality(d, (3, 3)), late="1 minute")
    streaming.write_patterns(out, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() >= 4 and got.filter("n = 6").count() >= 4


def test_a_table_of_offsets_is_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ebsp, "AT_ONCE", 2)
    data = RNG.integers(0, 256, (7, 8, 9)).astype(np.uint8)
    path = tmp_path / "a.ebsp"
    path.write_bytes(ebsp_bytes(5, data, [6, 2, 1, 3, 5, 4, 0], nx=7))
    assert ebsp.layout_of(str(path)).n == 7 and (read(load(spark, str(path))) == data.reshape(7, -1)).all()


def test_a_file_that_ends_early_is_told(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(bytes(range(30)))
    with pytest.warns(UserWarning, match="ends before its last pattern"):
        scan = load(spark, str(tmp_path / "a.dat"), ny=1, nx=3, rows=3, cols=4)
        assert read(scan)[2].tolist() == [*range(24, 30), 0, 0, 0, 0, 0, 0]


def chunked(data, chunk, shuffle, at):
    """A dataset in deflated chunks with a tree of two levels, to be put at byte ``at``; and where its header is."""
    out, leaves = bytearray(), []
    put = lambda b: (out.extend(b), at + len(out) - len(b))[1]
    rank, size = data.ndim + 1, data.dtype.itemsize
    for place in np.ndindex(*[-(-s // c) for s, c in zip(data.shape, chunk, strict=True)]):
        start = [p * c for p, c in zip(place, chunk, strict=True)]
        block = np.zeros(chunk, data.dtype)
        part = data[tuple(slice(p, p + c) for p, c in zip(start, chunk, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes() if shuffle else raw)
        leaves.append((start, put(raw), len(raw)))
    key = lambda start, n: struct.pack(f"<II{rank}Q", n, 0, *start, 0)
    node = lambda level, rows: b"TREE" + struct.pack("<BBHQQ", 1, level, len(rows), 2**64 - 1, 2**64 - 1) + b"".join(key(s, n) + struct.pack("<Q", a) for s, a, n in rows) + key([0] * data.ndim, 0)
    halves = [(leaves[k][0], put(node(0, leaves[k : k + 3])), 0) for k in range(0, len(leaves), 3)]
    tree = put(node(1, halves))
    space = struct.pack(f"<BBBB4x{data.ndim}Q", 1, data.ndim, 0, 0, *data.shape)
    layout = struct.pack(f"<BBBQ{rank}I", 3, 2, rank, tree, *chunk, size)
    filters = [(2, [size])] * shuffle + [(1, [4])]
    pipeline = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHII", i, 0, 0, 1, v[0], 0) for i, v in filters)
    header = put(hdf5._header([(1, space), (3, hdf5._type_message(data.dtype)), (11, pipeline), (8, layout)]))
    return bytes(out), header


@pytest.mark.parametrize("shuffle", [False, True])
def test_h5_chunks(spark, tmp_path, shuffle):
    """Patterns in deflated chunks, the last of them partly outside, as a scan."""
    data = RNG.integers(0, 60_000, (6, 4, 5)).astype("<u2")
    header = {"n_rows": 2, "n_columns": 3, "pattern_height": 4, "pattern_width": 5}
    # the file is made with a dataset in one piece, whose header is then replaced by that of the chunks
    head = hdf5.file_bytes({"manufacturer": "x", "Scan 1": {"EBSD": {"Header": header, "Data": {"patterns": np.zeros(1, np.uint8)}}}})
    old = hdf5.File(io.BytesIO(head)).address("Scan 1/EBSD/Data/patterns")
    body, new = chunked(data, (4, 4, 5), shuffle, len(head))
    raw = bytearray(head + body)
    k = raw.index(struct.pack("<Q", old))
    raw[k : k + 8] = struct.pack("<Q", new)
    (tmp_path / "a.h5").write_bytes(raw)
    scan = load(spark, str(tmp_path / "a.h5"))
    assert scan.map_shape() == (2, 3) and scan.shape == (4, 5) and (read(scan) == data.reshape(6, -1)).all()
    file = hdf5.File(io.BytesIO(bytes(raw)))
    assert (file.value(file.dataset(new)) == data).all()


def test_h5_values():
    tree = {"text": "né", "group": {"n": -3, "x": 2.5, "a": np.arange(12.0).reshape(3, 4), "b": np.arange(5, dtype=np.int16), "empty": {}}} | {f"k{n}": n for n in range(70)}
    back = hdf5.File(io.BytesIO(hdf5.file_bytes(tree))).read()
    assert back["text"] == "né" and back["group"]["n"] == -3 and back["group"]["x"] == 2.5 and back["k69"] == 69 and back["group"]["empty"] == {}
    assert (back["group"]["a"] == tree["group"]["a"]).all() and back["group"]["b"].tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="not an HDF5 file"):
        hdf5.File(io.BytesIO(b"x" * 200))


def test_binning_of_camera_modes():
    assert [h5ebsd.binning_of(m) for m in ("2x2 (622x512 px)", "Speed 3 (156x88 px)", "Resolution (1244x1024 px)", "odd", "")] == [2, 8, 1, None, None]
