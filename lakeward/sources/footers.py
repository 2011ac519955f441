"""Parquet footers: row groups, key-value metadata and the signature of a file's schema."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTERS = "path string, rows long, row_groups int, schema_id string, signature string"


def schema_signature(leaves: list[tuple[str, str]]) -> str:
    """Of sorted (field, physical type) leaves: changes when a column is added, dropped or widened."""
    return hashlib.sha256(";".join(f"{a}:{b}" for a, b in sorted(leaves)).encode()).hexdigest()


def read_footers(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """One row a file.  Spark reads the bytes, so any of its stores works; files are whole in a task, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                meta = pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata
                columns = [meta.schema.column(i) for i in range(len(meta.schema))]
                ident = (meta.metadata or {}).get(b"iceberg.schema.id")
                out.append((path, meta.num_rows, meta.num_row_groups, ident.decode() if ident else None, schema_signature([(c.path, c.physical_type) for c in columns])))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in FOOTERS.split(", ")])

    return spark.read.format("binaryFile").load(files).select(F.col("path"), F.col("content")).mapInArrow(run, FOOTERS)


def mixed_schemas(footers: DataFrame) -> bool:
    """Whether files of several schemas are among them; such sets are not compacted together."""
    return footers.select(F.coalesce("schema_id", "signature").alias("s")).distinct().count() > 1
