"""URL rules in a sorted array of digests.

Each rule (host, path) is one string, ``host + path``. The index is a file with the sorted xxhash64 digests of the rules,
the offsets of their strings in the order of the digests, and the strings. Workers map the file into memory, so that
those of one machine share its pages, and probe it with vectorised binary search: for each URL one probe for each of its
host's suffixes and each path length that rules have. A digest found is confirmed against the stored string, and where
several rules share a digest each of them is compared.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scanloom.llm.common import LOWER, UPPER, bounded_batches, scratch_path

#: Hosts and paths as the rules see them. Null and URLs without "://" give empty strings.
HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
VERDICTS = ("allow", "block")


def digest(rule: bytes) -> int:
    return xxhash.xxh64_intdigest(rule)


def index_bytes(rules: Iterable[tuple[str, str, str]], key=digest) -> bytes:
    """rules: (verdict, host, path). Of rules that name the same host and path, the first counts. Hosts are lower-cased."""
    table: dict[bytes, int] = {}
    lengths = set()
    for verdict, host, path in rules:
        rule = (host.translate(str.maketrans(UPPER, LOWER)) + path).encode()
        table.setdefault(rule, VERDICTS.index(verdict))
        lengths.add(len(path))
    order = sorted(table, key=lambda r: (key(r), r))
    keys = np.array([key(r) for r in order], np.uint64)
    offsets = np.cumsum([0, *map(len, order)]).astype(np.uint64)
    codes = np.array([table[r] for r in order], np.uint8)
    sizes = np.array(sorted(lengths), np.uint64)
    return struct.pack("<QQ", len(order), len(sizes)) + sizes.tobytes() + keys.tobytes() + offsets.tobytes() + codes.tobytes() + b"".join(order)


def write_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the index to the shared folder; its path."""
    path = scratch_path(spark, "url-rules")
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at))
    with fs.open_output_stream(at) as out:
        out.write(index_bytes(rules))
    return path


class DigestArray:
    """The index, mapped into memory. A file that isn't on a mounted file system is first copied to the worker."""

    def __init__(self, uri: str, key=digest):
        fs, path = pafs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() if not isinstance(fs, pafs.LocalFileSystem) else open(path, "rb") as file:
            if not isinstance(fs, pafs.LocalFileSystem):
                with fs.open_input_stream(path) as source:
                    while piece := source.read(1 << 20):
                        file.write(piece)
                file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = struct.unpack_from("<QQ", self.map)
        at = 16
        self.lengths = np.frombuffer(self.map, np.uint64, m, at)
        self.keys = np.frombuffer(self.map, np.uint64, n, at := at + 8 * m)
        self.offsets = np.frombuffer(self.map, np.uint64, n + 1, at := at + 8 * n)
        self.codes = np.frombuffer(self.map, np.uint8, n, at := at + 8 * (n + 1))
        self.base, self.key = at + n, key

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Index of the rule equal to each candidate, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not candidates or not len(self.keys):
            return found
        digests = np.fromiter(map(self.key, candidates), np.uint64, len(candidates))
        first = np.searchsorted(self.keys, digests, "left")
        last = np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(first < last):
            for k in range(first[i], last[i]):
                if self.map[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])] == candidates[i]:
                    found[i] = k
        return found

    def judge(self, hosts: list[str], paths: list[str], default: str) -> tuple[list[str | None], list[str]]:
        candidates, owner, sizes = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            at = 0
            while True:
                for n in self.lengths:
                    if n <= len(path):
                        rule = (host[at:] + path[: int(n)]).encode()
                        candidates.append(rule)
                        owner.append(i)
                        sizes.append(len(host) - at + int(n))
                at = host.find(".", at) + 1
                if not at:
                    break
        found = self.probe(candidates)
        rule: list[str | None] = [None] * len(hosts)
        verdict, best = [default] * len(hosts), [-1] * len(hosts)
        for j in np.flatnonzero(found >= 0):
            i = owner[j]
            if sizes[j] > best[i]:
                best[i], rule[i], verdict[i] = sizes[j], candidates[j].decode(), VERDICTS[self.codes[found[j]]]
        return rule, verdict


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all of its subdomains, if the path starts with the rule's. Of rules
    that fit the longest wins. URLs that no rule fits get ``default`` (the array lists exceptions, so "allow") and a null
    rule; so do null and empty URLs and those without "://", whose host and path are empty. Rule paths start with "/".
    Repeated rows are each judged; an empty table gives an empty result; other columns are ignored.
    """
    rules = list(rules)
    if bad := [r for r in rules if not r[2].startswith("/") or "/" in r[1]]:
        raise ValueError(f"a rule's path starts with /, and its host has none: {bad}")
    spark = pages.sparkSession
    bounded_batches(spark)
    path = write_index(spark, rules)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(path)
        for b in batches:
            rule, verdict = index.judge(b.column("host").to_pylist(), b.column("path").to_pylist(), default)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PATH, 1).alias("path"))
    schema = StructType([*rows.schema, StructField("rule", StringType()), StructField("verdict", StringType())])
    return rows.mapInArrow(judged, schema)
