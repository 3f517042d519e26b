"""Reads of BAM files, decoded block by block on the executors.

A file is one task: its compressed blocks are read in a stream, so memory stays bounded
however long the file is. The path must be one that executors can open.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READS = pa.schema([("qname", pa.string()), ("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("is_unmapped", pa.bool_())])
#: Operations of a CIGAR that take up reference bases: M, D, N, =, X.
_ON_REFERENCE = {0, 2, 3, 7, 8}
BATCH_ROWS = 20_000


def records(path: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(qname, chrom, start, end, is_unmapped) of every record, in file order."""
    with gzip.open(path, "rb") as file:  # blocks are gzip members one after the other

        def take(n: int) -> bytes:
            data = file.read(n)
            if len(data) < n:
                raise ValueError(f"{path}: ends within a record")
            return data

        if take(4) != b"BAM\x01":
            raise ValueError(f"{path}: not a BAM file")
        take(struct.unpack("<i", take(4))[0])
        names = []
        for _ in range(struct.unpack("<i", take(4))[0]):
            names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
            take(4)
        while head := file.read(4):
            body = take(struct.unpack("<i", head)[0])
            reference, start, name_size, _, _, n_steps, flag = struct.unpack_from("<iiBBHHH", body)
            steps = struct.unpack_from(f"<{n_steps}I", body, 32 + name_size)
            span = sum(s >> 4 for s in steps if s & 15 in _ON_REFERENCE)
            yield body[32 : 32 + name_size - 1].decode(), names[reference] if reference >= 0 else "*", start, start + max(span, 1), bool(flag & 4)


def _batches(paths: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in paths:
        for path in batch.column("path").to_pylist():
            rows = []
            for record in records(path):
                rows.append(record)
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READS)], schema=_READS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READS)], schema=_READS)


def read_bam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Reads of one BAM file: sample, qname, chrom, start, end, is_unmapped."""
    file = spark.range(0, 1, 1, 1).select(F.lit(path).alias("path"))
    found = file.mapInArrow(_batches, "qname string, chrom string, start long, end long, is_unmapped boolean")
    return found.select(F.lit(sample).alias("sample"), "*")
