"""Shared plumbing: scratch tables, files on shared storage, Arrow batches, joins on skewed keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once; bounds the memory of its intermediates.
SLICE_BYTES = 2 << 20
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one if Spark runs in this process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: executors share no folder for intermediate tables")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quillon-"))
        base = f"file://{_LOCAL[0]}"
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path in it) for files that Python workers read and write on shared storage."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "/" + uri[6:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, parts) -> str:
    """Write ``parts`` (bytes-likes) as folder/name under a name no other attempt has; returns the URI."""
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{own}", buffer_size=1 << 20) as out:
        for part in parts:
            out.write(part)
    return f"{folder}/{own}"


def read_file(uri: str) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Sub-batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    import numpy as np

    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = np.diff(offsets_of(col)[0])
        ends = np.cumsum(sizes)
        at = 0
        while at < len(col):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(col: pa.Array):
    """(offsets, bytes) of a string or binary array as numpy arrays; nulls are empty."""
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


#: Bytes of a stored table that one shuffle partition is to hold at most, on average.
PARTITION_BYTES = 128 << 20


def partitions(spark: SparkSession, *frames: DataFrame) -> int:
    """Shuffle partitions: the session's setting, or more where the stored ``frames`` exceed PARTITION_BYTES each.

    Sizes are Catalyst's, which knows those of the files that a plan reads; where it knows none (rows of an RDD)
    the setting holds.
    """
    known = 0
    for f in frames:
        leaves = f._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        known += sum(x for x in sizes if x < 1 << 60)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known // PARTITION_BYTES))


def fresh(columns, name: str) -> str:
    """``name``, or a longer one that no column has; names differ by case alone in Spark only if told so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Groups with over 1/HOT of all rows are hot; there are fewer than HOT of them, which bounds what is broadcast.
HOT = 2048


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``groups`` (one row per key, ``count`` rows each of ``total``) without a hot task.

    The hot groups, under HOT in number as each holds over 1/HOT of the rows (and 200 at least), are broadcast; the
    rest is an ordinary shuffle join. ``groups`` should be a written table, as it is read twice.
    """
    line = max(total // HOT, 200)
    hot, cold = groups.where(F.col(count) > line), groups.where(F.col(count) <= line)
    near = rows.join(F.broadcast(hot), keys, "inner")
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


@atexit.register
def _clean() -> None:
    import shutil

    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


