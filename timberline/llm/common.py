"""Helpers that the corpus operators share: the shared folder, written tables, bounded slices, salted joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes and rows that a Python kernel turns into Python objects at once.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 20_000
#: Bytes of a batch that goes to a Python kernel.
ARROW_BYTES = 4 << 20
#: A table of up to so many bytes may be broadcast, once its size was counted.
BROADCAST_BYTES = 32 << 20
_DIRS: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, one in the warehouse; on one machine (a local
    master), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _OWN:
            alone = master.startswith("local") and not master.startswith("local-cluster")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="timberline-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        path = _OWN[app]
    return path.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Called before a Python kernel is planned: Spark would gather up to 64 MB for it at once, in buffers that double as they grow; 4 MB will do."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/timberline/{label}-{uuid.uuid4().hex}"
    _DIRS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    narrow: its rows are a few numbers each, so a quarter of the shuffle's partitions makes files enough.
    """
    path, spark = new_path(df.sparkSession, label), df.sparkSession
    (df.coalesce(max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no result reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to the shared folder. Call it when their results are no longer read."""
    for path in _DIRS.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


#: What operators remember in a Python worker: how to forget it, by operator.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    _FORGET[operator] = forget


def begin(operator: str) -> None:
    """Called by a kernel as it starts. Spark uses Python workers again for other stages: what other operators remember there goes, and
    memory that is freed returns to the system instead of staying with the worker."""
    for other, forget in _FORGET.items():
        if other != operator:
            forget()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # fixed values: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        libc.mallopt(-1, 8 << 20)
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes in `column`, and SLICE_ROWS rows, at most; a longer value is alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64) + limit // SLICE_ROWS) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def count_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes in some columns of a table, by one aggregation; the check before a broadcast."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """left join on `key`, where one key may hold a third of the left rows: they are dealt to `salts` tasks and the right rows repeated for each."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b, [key, "__salt"], "left").drop("__salt")


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """The right side of a join: broadcast if its rows, counted, take no more than BROADCAST_BYTES, else hashed after a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_hash")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, number) of the distinct ids of a table, in their order: ranges are counted, and sums over the ranges give where each starts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranged = materialize(ids.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "ids")
    starts, at = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):  # a row for each of `parts` partitions
        starts += [F.lit(part), F.lit(at)]
        at += n
    own = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ranged.select(key, (F.try_element_at(F.create_map(*starts), F.col("part")) + own).cast("long").alias("number")) if starts else ids.withColumn("number", F.lit(0).cast("long"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to as many partitions as shuffles have."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that an operator is about to add under these names."""
    lower = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in lower])


def digits(value: Column) -> Column:
    """Lower-case hex SHA-256 of a string or binary column."""
    return F.sha2(value, 256)
