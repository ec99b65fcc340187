"""Packed volumes in shard files: the index, the ordered list of paths, and reading members by offset."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from volframe.operators.ordering import read_text_list
from volframe.plans.scratch import scratch_path

#: A member's arrays as a row.
VOLUME = "path string, values array<int>, scale double, mask_rle array<long>, shape array<int>, affine array<array<double>>"
#: A task reads about this much of a shard.
RANGE_BYTES = 128_000_000
#: Where members are listed, a stretch of a shard that one task reads on end, and tasks of the read for each core.
STRETCH_BYTES, TASKS_A_CORE = 1 << 20, 4
#: How a field of a member is stored in Arrow.
KINDS = {
    "path": pa.string(), "values": pa.list_(pa.int32()), "scale": pa.float64(), "mask_rle": pa.list_(pa.int64()), "shape": pa.list_(pa.int32()), "affine": pa.list_(pa.list_(pa.float64())),
}
FIELDS = tuple(KINDS)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, shard, offset, size); no other column of the index is read."""
    return spark.read.parquet(path).select("path", "shard", "offset", "size")


def read_filelist(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, path) of a text list of paths that any white space separates; a path with a blank would be two. The list may
    be one file or the parts of one; large files are read by many tasks."""
    return read_text_list(spark, path)


def missing_members(filelist: DataFrame, index: DataFrame) -> DataFrame:
    """(path): listed paths that the index does not have."""
    return filelist.join(index, "path", "left_anti").select("path").distinct()


def strict_lookup(filelist: DataFrame, index: DataFrame) -> DataFrame:
    """(ordinal, path, shard, offset, size) of every listed path, in list order, repeats and all.

    A listed path that the index lacks is an error, and so is a path that the index has twice, whichever columns are read
    and also where rows are only counted: a filter makes sure of each row.
    """
    unique = index.groupBy("path").agg(F.first("shard").alias("shard"), F.first("offset").alias("offset"), F.first("size").alias("size"), F.count("*").alias("_n"))
    found = filelist.join(unique, "path", "left")
    sure = F.when(F.col("_n") == 1, F.lit(True)).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("twice in the index: "), F.col("path")))).otherwise(F.raise_error(F.concat(F.lit("not in the index: "), F.col("path"))))
    return found.where(sure).select("ordinal", "path", "shard", "offset", "size").orderBy("ordinal")


class Member(io.RawIOBase):
    """The bytes of one member of an open file, as a file: an npz reader fetches only the arrays it is asked for."""

    def __init__(self, file, offset: int, size: int):
        self.file, self.offset, self.size, self.place = file, offset, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        self.place = to + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.size}[whence]
        return self.place

    def readinto(self, into) -> int:
        wanted = min(len(into), self.size - self.place)
        if wanted <= 0:
            return 0
        self.file.seek(self.offset + self.place)
        got = self.file.read(wanted)
        into[: len(got)] = got
        self.place += len(got)
        return len(got)


def decode(file, offset: int, size: int, fields: Sequence[str]) -> dict[str, np.ndarray]:
    """The arrays of these names of the npz record at an offset; others are not read."""
    with np.load(io.BufferedReader(Member(file, offset, size))) as z:
        return {f: z[f] for f in fields if f != "path"}


def _open(root: str, shard: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(root)
    return files.open_input_file(f"{path}/{shard}")


def _listed(arrays: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays as lists over one buffer of their values, by rows where they are matrices."""
    inner = kind.value_type
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    if pa.types.is_list(inner):
        values = _listed([row for a in arrays for row in a], inner)
    else:
        values = pa.array(np.concatenate([*arrays, np.zeros(0)]).astype(inner.to_pandas_dtype()), inner)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _batch(paths: list[str], members: list[dict], fields: Sequence[str]) -> pa.RecordBatch:
    def column(f: str) -> pa.Array:
        if f == "path":
            return pa.array(paths, pa.string())
        if f == "scale":
            return pa.array([float(m[f]) for m in members], pa.float64())
        return _listed([m[f] for m in members], KINDS[f])

    return pa.RecordBatch.from_arrays([column(f) for f in fields], list(fields))


def _members(root: str, rows: Iterator[tuple[str, str, int, int]], fields: Sequence[str], batch_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of members (path, shard, offset, size), which come by shard and offset: a shard is opened once and read
    forward."""
    name, file, paths, members = None, None, [], []
    for path, shard, offset, size in rows:
        if shard != name:
            if file:
                file.close()
            name, file = shard, _open(root, shard)
        paths.append(path)
        members.append(decode(file, offset, size, fields))
        if len(paths) == batch_rows:
            yield _batch(paths, members, fields)
            paths, members = [], []
    if file:
        file.close()
    if paths:
        yield _batch(paths, members, fields)


def read_members(lookup: DataFrame, root: str, batch_rows: int = 8) -> DataFrame:
    """(path, values, scale, mask_rle, shape, affine) of the members of a lookup (path, shard, offset, size).

    Rows go to tasks by shard and stretch of the shard, in order of offset, so that a task opens a shard once and reads
    forward, and a shard is read by many tasks. Their number is fixed by the cores: rows of a lookup are narrow, and Spark
    would join partitions of few bytes into one task, however long their members take to read. root is a URI that executors
    can open.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    tasks = TASKS_A_CORE * lookup.sparkSession.sparkContext.defaultParallelism
    ordered = lookup.select("path", "shard", "offset", "size").repartition(tasks, F.col("shard"), stretch).sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _members(root, (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), FIELDS, batch_rows)

    return ordered.mapInArrow(run, VOLUME)


def plan_stretches(index: DataFrame, path: str, range_bytes: int = RANGE_BYTES) -> None:
    """Write the plan of a read: a row for each stretch of a shard, with the members that begin in it.

    (shard, first, after, members, low, high): the bytes from the first member to the end of the last, the members' (offset,
    size, path) in order, and the smallest and greatest path. Rows of a stretch are bounded by its bytes, so one shard of
    any size is many stretches. Null paths, offsets or sizes are an error.
    """
    sound = F.col("path").isNotNull() & F.col("shard").isNotNull() & F.col("offset").isNotNull() & F.col("size").isNotNull()
    rows = index.select("path", "shard", "offset", "size").where(F.when(sound, True).otherwise(F.raise_error(F.lit("the index has a null path, shard, offset or size"))))
    stretches = rows.groupBy("shard", F.floor(F.col("offset") / range_bytes).alias("stretch")).agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("size")).alias("after"),
        F.sort_array(F.collect_list(F.struct("offset", "size", "path"))).alias("members"), F.min("path").alias("low"), F.max("path").alias("high"),
    )
    stretches.drop("stretch").write.parquet(path)


@dataclass
class Stretch(InputPartition):
    """Where a stretch's row of the plan is: file, row group and row within it; the members travel with the task's read."""

    shard: str
    first: int
    after: int
    file: str
    row_group: int
    row: int


class ShardReader(DataSourceReader):
    """Reads the stretches of a plan. The driver sees a plan's narrow columns, a row for each stretch."""

    def __init__(self, root: str, plan: str, fields: Sequence[str], batch_rows: int):
        self.root, self.plan, self.fields, self.batch_rows = root, plan, tuple(fields), batch_rows
        self.paths: frozenset | None = None
        self.starts: tuple[str, ...] = ()

    def _only(self, paths: set) -> None:
        self.paths = frozenset(paths) if self.paths is None else self.paths & paths

    def wanted(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(s) for s in self.starts)

    def _may_have(self, low: str, high: str) -> bool:
        """Whether a wanted path may lie between the two; in bytes, as Spark orders them."""
        low, high = low.encode(), high.encode()
        if self.paths is not None and not any(low <= p.encode() <= high for p in self.paths if p is not None):
            return False
        return all(low[: len(s.encode())] <= s.encode() <= high for s in self.starts)

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.plan)
        found: list[InputPartition] = []
        for info in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
            if not info.path.endswith(".parquet"):
                continue
            with files.open_input_file(info.path) as f:
                parquet = pq.ParquetFile(f)
                for g in range(parquet.num_row_groups):
                    columns = parquet.read_row_group(g, columns=["shard", "first", "after", "low", "high"]).to_pydict()
                    rows = zip(*(columns[c] for c in ("shard", "first", "after", "low", "high")), strict=True)
                    found += [Stretch(s, a, z, info.path, g, i) for i, (s, a, z, low, high) in enumerate(rows) if self._may_have(low, high)]
        return found or [Stretch("", 0, 0, "", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if not partition.file:
            return
        files, _ = fs.FileSystem.from_uri(self.plan)
        with files.open_input_file(partition.file) as f:
            members = pq.ParquetFile(f).read_row_group(partition.row_group, columns=["members"]).column("members")[partition.row].values
        rows = ((p, partition.shard, o, n) for o, n, p in zip(*(members.field(c).to_pylist() for c in ("offset", "size", "path")), strict=True) if self.wanted(p))
        yield from _members(self.root, rows, self.fields, self.batch_rows)


class FilteringShardReader(ShardReader):
    """A reader that is told of filters. Spark refuses one where spark.sql.python.filterPushdown.enabled is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equal paths, lists of paths and beginnings of paths are checked before a member is read; others are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("path",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.starts += (f.value,)
            else:
                yield f


class Shards(DataSource):
    """Format `shards`: options path (the folder of shards), plan (the folder plan_stretches() wrote), both URIs, batch_rows,
    and pushdown (true where spark.sql.python.filterPushdown.enabled is): then filters on path are checked before members
    are read. A schema of fewer columns reads only those arrays of each member."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return VOLUME

    def reader(self, schema) -> ShardReader:
        unknown = [f.name for f in schema.fields if f.name not in KINDS]
        if unknown:
            raise ValueError(f"a member has no {', '.join(unknown)}")
        kind = FilteringShardReader if self.options.get("pushdown", "false").lower() == "true" else ShardReader
        return kind(self.options["path"], self.options["plan"], [f.name for f in schema.fields], int(self.options.get("batch_rows", 8)))


def load_shards(index: DataFrame, root: str, columns: Sequence[str] = FIELDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of an index (path, shard, offset, size) through the data source: a Spark job plans the stretches, then
    each is a task of the read. columns: those to read; arrays of others stay on disk."""
    spark = index.sparkSession
    plan = scratch_path(spark, "stretches")
    plan_stretches(index, plan, range_bytes)
    spark.dataSource.register(Shards)
    kinds = dict(c.split(" ", 1) for c in VOLUME.split(", "))
    return spark.read.format("shards").schema(", ".join(f"`{c}` {kinds[c]}" for c in columns)).option("path", root).option("plan", plan).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()


def write_members(volumes: DataFrame, root: str, shard_bytes: int = 1 << 30) -> DataFrame:
    """Write packed volumes (VOLUME) as uncompressed npz members in shard files below root, a URI; gives their index
    (path, shard, offset, size). A task writes its rows in turn and begins a new shard after shard_bytes. The index is of
    tasks that ended well; shards of others are left over, under names that nothing refers to. Read the index once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(root)
        files.create_dir(at, recursive=True)
        name, out, place = "", None, 0
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                path, values, scale, runs, shape, affine = (b.column(j)[i] for j in range(6))
                raw = io.BytesIO()
                matrix = affine.values.flatten().to_numpy().reshape(len(affine.values), -1)
                np.savez(raw, values=values.values.to_numpy(), scale=scale.as_py(), mask_rle=runs.values.to_numpy(), shape=shape.values.to_numpy(), affine=matrix)
                if out is None or place >= shard_bytes:
                    if out:
                        out.close()
                    name, place = f"shard-{uuid.uuid4().hex}", 0
                    out = files.open_output_stream(f"{at}/{name}")
                out.write(raw.getvalue())
                rows.append((path.as_py(), name, place, raw.tell()))
                place += raw.tell()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "shard", "offset", "size"])
        if out:
            out.close()

    return volumes.select(*FIELDS).mapInArrow(run, "path string, shard string, offset long, size long")
