"""Helpers shared by the operators: staged tables, order-preserving ids, running maxima, components."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, work_dir
from .bytescan import drop_large_tables

#: The word of the contracts: a run of bytes other than space and \t \n \v \f \r.
#: ``bytes.split()`` without argument cuts at exactly these six bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker is handed at once while a table is staged; texts may be long.
BATCH_ROWS = 2_000


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut all executors can read.

    ``codec`` is another compression than the session's, for copies of texts that take much disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.mode("overwrite").parquet(path, compression=codec)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark drop the shuffle files of finished stages.

    Shuffle files go when the driver's garbage collector finds their plan unused,
    which on a large driver heap may be long after.
    """
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jvm.System.gc()


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """A row number that tells repeated rows apart (stable: partition and place in a file scan)."""
    return df.withColumn(name, F.monotonically_increasing_id())


_held: dict = {}


def held(key, make):
    """What ``make`` returns, kept by a Python worker for its next tasks until one of another kind lets it go."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """At the start of a scan: workers are passed on from job to job, with all that earlier ones made them keep."""
    if _held:
        _held.clear()
        gc.collect()
        give_back_memory()


def give_back_memory() -> None:
    """Return freed buffers of a Python worker to the system: it may stay idle beside other work."""
    drop_large_tables()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps them otherwise
    if trim is not None:
        trim(0)


def partition_id() -> int:
    return TaskContext.get().partitionId()


def list_array(values: np.ndarray, lengths, typ: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, typ))


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of an Arrow list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy(zero_copy_only=False)
    vals = col.values.to_numpy(zero_copy_only=False)
    return vals[off[0]:off[-1]] if len(off) else vals, off - (off[0] if len(off) else 0)


def running_max(df: DataFrame, keys: list[str], value: str, out: str, name: str) -> DataFrame:
    """``out`` = largest non-null ``value`` (>= 1) among rows up to this one in the order of ``keys``; 0 if none.

    Range partitions are sorted, each takes its running maximum in batches, and
    the maxima of earlier partitions (one number for each partition) are added.
    """
    spark = df.sparkSession
    fields = df.schema

    def local(batches):
        top, pid = 0, partition_id()
        for b in batches:
            v = b.column(fields.names.index(value)).fill_null(0).to_numpy(zero_copy_only=False)
            run = np.maximum(np.maximum.accumulate(v), top) if len(v) else v
            top = int(run[-1]) if len(run) else top
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(run, pa.int64()), pa.array(np.full(len(run), pid, np.int32))],
                names=[*b.schema.names, "_run", "_pid"])

    schema = fields.simpleString()[len("struct<"):-1] + ",_run:bigint,_pid:int"
    done = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local, schema), name)
    tops = sorted((r["_pid"], r["m"]) for r in done.groupBy("_pid").agg(F.max("_run").alias("m")).collect())
    carry, top = [], 0
    for pid, m in tops:
        carry.append((pid, top))
        top = max(top, m)
    prior = spark.createDataFrame(carry or [(-1, 0)], "_pid int, _carry long")
    rows = done.join(F.broadcast(prior), "_pid").withColumn(out, F.greatest("_run", "_carry")).drop("_run", "_pid", "_carry")
    rows._staged_at = done._staged_at
    return rows


def running_sum(df: DataFrame, keys: list[str], value: str, out: str, name: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows before this one in the order of ``keys``.

    One range shuffle; only one total for each partition reaches the driver.
    """
    spark = df.sparkSession
    fields = df.schema

    def local(batches):
        total, pid = 0, partition_id()
        for b in batches:
            v = b.column(fields.names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(v) + total
            total = int(run[-1]) if len(run) else total
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(run - v, pa.int64()), pa.array(np.full(len(v), pid, np.int32))],
                names=[*b.schema.names, "_run", "_pid"])

    schema = fields.simpleString()[len("struct<"):-1] + ",_run:bigint,_pid:int"
    done = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local, schema), name)
    totals = sorted((r["_pid"], r["s"]) for r in
                    done.groupBy("_pid").agg(F.max(F.col("_run") + F.col(value)).alias("s")).collect())
    carry, total = [], 0
    for pid, s in totals:
        carry.append((pid, total))
        total += s
    prior = spark.createDataFrame(carry or [(-1, 0)], "_pid int, _carry long")
    rows = (done.join(F.broadcast(prior), "_pid")
            .withColumn(out, F.col("_run") + F.col("_carry")).drop("_run", "_pid", "_carry"))
    rows._staged_at = done._staged_at
    return rows


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component = smallest node reachable.

    Alternating large-star and small-star rounds: each rewires every node to the
    smallest neighbour it knows, so the links stay as many as the nodes and no
    adjacency list is gathered. Each round is a written table (lineage cut).
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .filter("u <> v").distinct(), f"{name}-e0")
    state = None
    for i in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (joined.select("u", F.col("m").alias("v"))
                 .union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        e = stage(small, f"{name}-e{i + 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == (now[0], now[1]):
            break
        state = (now[0], now[1])
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


__all__ = ["WORD_RE", "stage", "read_documents", "with_uid", "partition_id", "list_array", "flat",
           "running_max", "running_sum", "connected_components", "work_dir"]
