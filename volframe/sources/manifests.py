"""The image manifest: many Parquet files that must all have the declared columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGES = "path string, collection string, subject string, suffix string, dwi_type string, warnings array<string>, mask_extent array<double>"


def declared(schema: str) -> dict[str, str]:
    """Column -> type, as Spark writes types."""
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}


def schema_faults(spark: SparkSession, path: str, schema: str = IMAGES) -> DataFrame:
    """(file, column, expected, found): where a file of a folder lacks a declared column (found is null) or has it with
    another type. Tasks read the files' footers, and Spark their list; other columns are no faults. A file that is no
    Parquet has one row, with a null column. The files must be such as pyarrow can open: local, HDFS or S3."""
    want = declared(schema)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import from_arrow_schema

        for b in batches:
            faults = []
            for name in b.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(name)
                try:
                    with files.open_input_file(at) as f:
                        own = {x.name: x.dataType.simpleString() for x in from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=False).fields}
                except (pa.ArrowInvalid, TypeError) as e:
                    faults.append((name, None, "parquet", str(e)[:200]))
                    continue
                faults += [(name, c, kind, own.get(c)) for c, kind in want.items() if own.get(c) != kind]
            columns = list(zip(*faults, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", "column", "expected", "found"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.mapInArrow(footers, "file string, column string, expected string, found string")


def read_manifest(spark: SparkSession, path: str, schema: str = IMAGES) -> DataFrame:
    """The declared columns of all Parquet files of a folder. A column that some file lacks, or has with another type, is
    an error before any row is read; Spark alone would give nulls for the one and fail in some task for the other."""
    found = schema_faults(spark, path, schema)
    first = found.orderBy("file", "column").limit(10).collect()  # enough to say what is wrong
    if first:
        said = "; ".join(f"{r.file}: " + (f"{r.column} is {r.found or 'missing'}, not {r.expected}" if r.column else f"not Parquet ({r.found})") for r in first)
        raise ValueError(f"files do not have the declared schema: {said}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def write_manifest(images: DataFrame, path: str) -> None:
    """images as a manifest: the declared columns alone, with the declared types."""
    images.select(*(F.col(c).cast(kind).alias(c) for c, kind in declared(IMAGES).items())).write.parquet(path)
