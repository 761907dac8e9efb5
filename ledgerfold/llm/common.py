"""Helpers shared by the operators: tables, scratch tables, shared files.

Everything an operator writes goes below the folder that the cluster names in
``spark.checkpoint.dir`` (``ledgerfold.session.checkpoint_dir``), which driver
and executors share.  Spark writes tables there; raw files (array shards, WARC
archives) are written by tasks under a temporary name and then renamed, so a
task that runs twice leaves one complete file.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, uri: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage, and what was
    computed survives lost executors."""
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns named by place, so that one may be selected twice and
    the caller's names cannot clash with an operator's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, ...) or plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, name: str, parts: Iterable) -> int:
    """Write buffers as file ``name`` of folder ``uri`` through a temporary
    name; returns the bytes written."""
    system, folder = located(uri)
    system.create_dir(folder, recursive=True)
    temporary, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(temporary, f"{folder}/{name}")
    return size


def remove(uri: str) -> None:
    """Delete a scratch folder of this operator."""
    system, folder = located(uri)
    if system.get_file_info(folder).type != pafs.FileType.NotFound:
        system.delete_dir(folder)


_FETCHED: dict[str, str] = {}


def local_file(uri: str, name: str) -> str:
    """Path that can be memory-mapped.  A shared folder that is mounted is used
    as it is; from an object store the file is fetched once per worker."""
    system, folder = located(uri)
    path = f"{folder}/{name}"
    if isinstance(system, pafs.LocalFileSystem):
        return path
    key = f"{uri}/{name}"
    if key not in _FETCHED:
        if not _FETCHED:
            _FETCHED[""] = tempfile.mkdtemp(prefix="llm-arrays-")
            atexit.register(shutil.rmtree, _FETCHED[""], ignore_errors=True)
        target = os.path.join(_FETCHED[""], str(len(_FETCHED)))
        pafs.copy_files(path, target, source_filesystem=system, destination_filesystem=pafs.LocalFileSystem())
        _FETCHED[key] = target
    return _FETCHED[key]


def mapped(path: str) -> np.ndarray:
    """The file's bytes, memory-mapped.  The file itself does not stay open, so a
    process may map more files than it may have open."""
    with open(path, "rb") as file:
        if not os.fstat(file.fileno()).st_size:
            return np.empty(0, np.uint8)
        untracked = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **untracked), np.uint8)


class SortedArrays:
    """Sorted 64-bit keys with parallel arrays of counts, in shards by the keys'
    top bits.  The shards that a task stores are one file of plain arrays, as
    narrow as its largest count allows, which is memory-mapped when first
    searched; so there are as many files as tasks, however many shards the rows
    need.  ``layout`` gives each shard's file, its number of keys and widths, so a
    missing file is an error and never taken for an empty shard."""

    #: Columns of what ``write`` returns.
    STORED = ("shard", "file", "keys", "widths")

    def __init__(self, uri: str, bits: int, layout: dict[int, tuple[int, int, int]]):
        self.uri, self.bits = uri, bits
        self.files = {file: (keys, widths) for file, keys, widths in layout.values()}
        self.file_of = np.full(1 << bits, -1, dtype=np.int32)
        for shard, (file, _, _) in layout.items():
            self.file_of[shard] = file
        self.base = {}
        self.size = 0
        for file in sorted(self.files):
            self.base[file] = self.size
            self.size += self.files[file][0]
        self._open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    @staticmethod
    def write(uri: str, bits: int, keys: np.ndarray, counts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """Store all keys of one or more whole shards as one file; returns (shard,
        file, the file's number of keys, widths of its counts as hexadecimal
        digits) of each shard."""
        if not len(keys):
            return []
        order = np.argsort(keys)
        keys, counts = keys[order], [c[order] for c in counts]
        shards = np.unique(shard_of(keys, bits)).tolist()
        widths = [next(w for w in (1, 2, 4, 8) if w == 8 or int(c.max()) < 1 << (8 * w)) for c in counts]
        put(uri, f"{shards[0]}.bin", [keys.tobytes(), *[c.astype(f"<u{w}").tobytes() for c, w in zip(counts, widths, strict=True)]])
        return [(shard, shards[0], len(keys), sum(w << (4 * i) for i, w in enumerate(widths))) for shard in shards]

    def _file(self, file: int) -> tuple[np.ndarray, ...]:
        if file not in self._open:
            n, widths = self.files[file]
            raw = mapped(local_file(self.uri, f"{file}.bin"))
            arrays, at = [raw[:8 * n].view("<u8")], 8 * n
            while widths:
                width, widths = widths & 15, widths >> 4
                # a count column need not begin at a multiple of its width
                arrays.append(np.ndarray(n, f"<u{width}", buffer=raw, offset=at))
                at += n * width
            self._open[file] = tuple(arrays)
        return self._open[file]

    def find(self, keys: np.ndarray, columns: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted ``keys``: position in the whole array (-1: absent) and the
        first ``columns`` counts (0 where absent)."""
        position = np.full(len(keys), -1, dtype=np.int64)
        counts = [np.zeros(len(keys), dtype=np.int64) for _ in range(columns)]
        if not len(keys):
            return position, counts
        files = self.file_of[shard_of(keys, self.bits)]
        # a file's keys stay sorted
        order = np.argsort(files, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(files[order]) != 0])
        for a, b in zip(edges, np.r_[edges[1:], len(keys)], strict=True):
            file = int(files[order[a]])
            if file < 0:
                continue
            own, *rest = self._file(file)
            rows = order[a:b]
            at = np.searchsorted(own, keys[rows])
            at[at == len(own)] = 0
            hit = own[at] == keys[rows]
            rows, at = rows[hit], at[hit]
            position[rows] = at + self.base[file]
            for out, column_ in zip(counts, rest, strict=False):
                out[rows] = column_[at]
        return position, counts


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def signed(keys: np.ndarray) -> np.ndarray:
    """uint64 bit patterns as the int64 that Spark's bigint holds."""
    return keys.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)
