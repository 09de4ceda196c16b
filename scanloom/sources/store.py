"""The native store: a folder of Parquet tables that holds any number of scans.

``patterns`` is partitioned by scan, so one scan is read without touching others; within it files are sorted by map
position, so a crop of the map reads the row groups that it needs. ``scans`` has one row of metadata per scan, ``xmap`` the
crystal maps.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.detector import Detector
from scanloom.scan import Scan


def _scans(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scans")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("scan_id string, meta string").parquet(f"{path}/scans")


def scan_ids(spark: SparkSession, path: str) -> list[str]:
    table = _scans(spark, path)
    return [] if table is None else sorted(r[0] for r in table.select("scan_id").distinct().collect())


def write_scan(scan: Scan, path: str, scan_id: str = "1") -> None:
    """Adds a scan to the store; one of that name must not be there."""
    spark = scan.df.sparkSession
    if scan_id in scan_ids(spark, path):
        raise ValueError(f"the store has a scan {scan_id!r} already")
    ordered = scan.df.withColumn("scan_id", F.lit(scan_id)).repartitionByRange("y", "x").sortWithinPartitions("y", "x")
    ordered.write.mode("append").partitionBy("scan_id").parquet(f"{path}/patterns")
    if scan.xmap is not None:
        scan.xmap.withColumn("scan_id", F.lit(scan_id)).write.mode("append").partitionBy("scan_id").parquet(f"{path}/xmap")
    d = scan.detector
    detector = None if d is None else {"shape": d.shape, "px_size": d.px_size, "binning": d.binning, "tilt": d.tilt, "azimuthal": d.azimuthal, "twist": d.twist, "sample_tilt": d.sample_tilt, "pc": d.pc.tolist()}
    meta = {"shape": scan.shape, "dtype": scan.dtype, "nav_shape": scan.nav_shape, "step": scan.step, "unit": scan.unit, "static_background": None if scan.static_background is None else np.ravel(scan.static_background).tolist(), "detector": detector, "metadata": scan.metadata, "has_xmap": scan.xmap is not None}
    # last, so that a scan that is listed is whole
    spark.createDataFrame([(scan_id, json.dumps(meta))], "scan_id string, meta string").coalesce(1).write.mode("append").parquet(f"{path}/scans")


def read_scan(spark: SparkSession, path: str, scan_id: str | None = None) -> Scan:
    """A scan of the store, by default the first."""
    there = scan_ids(spark, path)
    if not there or (scan_id is not None and scan_id not in there):
        raise ValueError(f"the store has no scan {scan_id!r}, but {there}")
    scan_id = there[0] if scan_id is None else scan_id
    meta = json.loads(_scans(spark, path).filter(F.col("scan_id") == scan_id).first()["meta"])
    detector = meta["detector"]
    if detector is not None:
        detector = Detector(**{**detector, "shape": tuple(detector["shape"]), "pc": np.array(detector["pc"])})
    one = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("scan_id") == scan_id).drop("scan_id")
    background = meta["static_background"]
    return Scan(one("patterns"), tuple(meta["shape"]), meta["dtype"], meta["nav_shape"] and tuple(meta["nav_shape"]), detector, None if background is None else np.array(background), one("xmap") if meta["has_xmap"] else None, tuple(meta["step"]), meta["unit"], meta["metadata"])
