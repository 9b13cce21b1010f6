"""Binary spill files of scan events, directory sums and directory owners.

Records are little-endian: ``uid u32, size u64, length u32, path`` (owners
without size). A file may begin with its kind's eight magic bytes. Records before
a cut are kept. Files are read through Spark, so any store will do; a scanner
bounds its files by their flush size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sanitize

#: Magic bytes and record layouts of the formats.
KINDS = {"scan_t": (b"CDSKSEV1", "<IQI"), "diragg_t": (b"CDSKDAV1", "<IqI"), "dirowner_t": (b"CDSKDOV1", "<II")}
ROWS_A_BATCH = 50_000


def records(raw: bytes, kind: str) -> Iterator[tuple[int, int | None, str]]:
    """uid, size (none for owners), path of each whole record."""
    magic, layout = KINDS[kind]
    head = struct.Struct(layout)
    at = len(magic) if raw.startswith(magic) else 0
    while at + head.size <= len(raw):
        fields = head.unpack_from(raw, at)
        at += head.size
        if at + fields[-1] > len(raw):
            return
        yield fields[0], fields[1] if len(fields) == 3 else None, raw[at : at + fields[-1]].decode("utf-8", errors="replace")
        at += fields[-1]


def pack(kind: str, rows: Iterator[tuple]) -> bytes:
    """A file of ``kind``: rows (uid, size, path), or (uid, path) for owners."""
    magic, layout = KINDS[kind]
    out = [magic]
    for *numbers, path in rows:
        raw = path.encode("utf-8")
        out += [struct.pack(layout, *numbers, len(raw)), raw]
    return b"".join(out)


def payloads(rows: DataFrame, kind: str = "scan_t") -> DataFrame:
    """content: event files of at most ``ROWS_A_BATCH`` of the rows (uid, size, path; owners: uid, path)."""
    names = ["uid", "path"] if kind == "dirowner_t" else ["uid", "size", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS_A_BATCH):
                part = b.slice(at, ROWS_A_BATCH)
                content = pack(kind, zip(*(part[c].to_pylist() for c in names), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

    return rows.select(*names).mapInArrow(run, "content binary")


def parsed(files: DataFrame, kind: str = "scan_t") -> DataFrame:
    """uid, size, path of the records of event files (content), control characters replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["content"]:
                part: list[tuple] = []
                for row in records(raw.as_py(), kind):
                    part.append(row)
                    if len(part) == ROWS_A_BATCH:
                        yield batch(part)
                        part = []
                yield batch(part)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["uid", "size", "path"])

    return files.select("content").mapInArrow(run, "uid long, size long, path string").withColumn("path", sanitize(F.col("path")))


def read(spark: SparkSession, folder: str, kind: str = "scan_t") -> DataFrame:
    """uid, size, path of all ``<kind>*.bin`` files of a folder, control characters replaced."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", f"{kind}*.bin").load(folder), kind)
