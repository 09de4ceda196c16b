"""Where patterns come from and go to."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from scanloom.operators.detector import Detector
from scanloom.scan import Scan
from scanloom.sources import ebsp, edax, h5ebsd, images, nordif, store
from scanloom.sources.files import warn_if_short

SOURCES = (nordif.NordifSource, edax.EdaxSource, ebsp.EbspSource, h5ebsd.H5Source)
#: Formats by file extension.
EXTENSIONS = {"dat": "nordif", "up1": "edax_up", "up2": "edax_up", "ebsp": "oxford_ebsp", "h5": "h5ebsd", "hdf5": "h5ebsd", "h5ebsd": "h5ebsd", "h5oina": "h5ebsd"}


def register(spark: SparkSession) -> None:
    """Make the formats known to ``spark.read.format``."""
    for source in SOURCES:
        spark.dataSource.register(source)


def load(spark: SparkSession, path: str, format: str | None = None, **options) -> Scan:
    """A scan from a file or a folder: by extension, a folder of images, or a store of scans (``scan_id`` picks one)."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    name = format or EXTENSIONS.get(suffix)
    if name == "images" or (name is None and options.get("pattern")):
        df = images.read_directory(spark, path, **options)
        shape = df.select("rows", "cols").first()
        return Scan(df.drop("rows", "cols"), tuple(shape), "uint8")
    if name is None:
        return store.read_scan(spark, path, options.get("scan_id"))
    register(spark)
    known = {s.name(): s for s in SOURCES}
    if name not in known:
        raise ValueError(f"unknown format {name!r}, it is one of {sorted(known)}")
    options = {k: str(v) for k, v in options.items()}
    layout = known[name](options={"path": path, **options}).layout()
    warn_if_short(path, layout)
    df = spark.read.format(name).options(**options).load(path)
    detector = background = None
    if name == "h5ebsd":
        found = h5ebsd.find(path, options.get("scan"))
        detector, background = found.detector, found.static_background
    if "settings" in options:
        detector = Detector(**nordif.read_settings(options["settings"]).detector())
    if name == "nordif":
        background = nordif.static_background(path.rpartition("/")[0] or ".")
    return Scan(df, layout.shape, layout.dtype, (layout.ny, layout.nx), detector, background, step=layout.step, unit="um" if layout.step != (1.0, 1.0) else "px")


def _exists(path: str) -> bool:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def save(scan: Scan, path: str, scan_id: str = "1", overwrite: bool | None = None) -> bool:
    """To a raw file of 8-bit patterns if the path ends in .dat, to an .up1, .up2, .ebsp or .h5 file, else to a store of scans.

    An .up1, .up2 or .h5 file, and a .dat file of a scan with ``nav_shape``, has a pattern for every point of the map: zeros
    where the scan has none. Folders that are missing are made. A file that is there is replaced if ``overwrite`` is true,
    kept if it is false, and otherwise an error. Whether something was written.
    """
    suffix = path.lower().rsplit("/", 1)[-1].rpartition(".")[2]
    if suffix not in EXTENSIONS:
        store.write_scan(scan, path, scan_id)
        return True
    if _exists(path) and not overwrite:
        if overwrite is None:
            raise FileExistsError(path)
        return False
    if suffix == "dat":
        nordif.write_nordif(scan.df, path, nav_shape=scan.nav_shape)
    elif EXTENSIONS[suffix] == "h5ebsd":
        h5ebsd.write_h5(scan.df, path, scan.shape, scan.map_shape(), scan.dtype, scan.detector, scan.step, scan.static_background, scan_id if scan_id != "1" else "Scan 1")
    elif suffix == "ebsp":
        ebsp.write_ebsp(scan.df, path, scan.shape, scan.df.count(), scan.step[1], scan.dtype)
    else:
        edax.write_edax(scan.df, path, scan.shape, scan.map_shape(), scan.step)
    return True


def save_decomposition_model(scan: Scan, path: str, components=None, scan_id: str = "1") -> bool:
    """The model of a scan from some of its components, written by the tasks as it is computed."""
    return save(scan.get_decomposition_model(components), path, scan_id)
