"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import sys
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word, as the contract's ``[^\x20\x09-\x0D]+`` has it.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only where none is set and the
    executors are threads of the driver."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file:///tmp/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


class _Stages(threading.local):
    """Of each thread, so that pipelines in several threads leave each other's tables alone: whether a stage runs, and the
    tables of the stage that runs or ran last. Tables made outside of stages are not listed and never deleted here."""

    def __init__(self):
        self.running, self.made = False, []


_STAGES = _Stages()
#: Rows of an Arrow batch in the pipeline.
RECORDS = "2000"


def stored(df: DataFrame, label: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, is computed once.

    With ``keep`` the table is the caller's; others that a pipeline stage makes go at the next ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if _STAGES.running and not keep:
        _STAGES.made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs now; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, still: DataFrame) -> None:
    """Deletes the tables that earlier stages have made, but those that ``still`` reads."""
    read = "\n".join(still.inputFiles()) if _STAGES.made else ""
    for path in list(_STAGES.made):
        name = path.rsplit("/", 1)[1]
        if name not in read:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _STAGES.made.remove(path)


def stage(f):
    """A pipeline stage: its input is the written result of the one before in the same thread, whose own tables can go then."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        tidy(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS)  # long texts: bounds a worker's memory
        _STAGES.running = True
        try:
            return f(spark, docs, sf_dir)
        finally:
            _STAGES.running = False

    return run


@contextlib.contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """What stages set in the session is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh() -> None:
    """For the start of a task in a Python worker: drops what tasks of another kind, the encoders, have remembered."""
    if "tessera.llm.tokens" in sys.modules:
        sys.modules["tessera.llm.tokens"]._OPEN.clear()
    gc.enable()
    trim()


def with_rows(docs: DataFrame, file: str = "_file", at: str = "_at") -> DataFrame:
    """``docs`` with the identity of each row: the file that it is read from and its place there, which are the same however
    often and in whatever tasks the file is read. Rows that no one file holds are written first."""
    mark = lambda df: df.select("*", F.xxhash64(df.metadataColumn("_metadata")["file_path"]).alias(file), df.metadataColumn("_metadata")["row_index"].alias(at))
    try:
        return mark(docs)
    except AnalysisException:
        return mark(stored(docs, "rows"))


#: A key with more than this share of a table's rows is hot; so there are at most as many hot keys.
HOT = 1000


def dealt_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", count: str | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key at most. Rows of hot keys, each more than 1 in ``HOT`` of all,
    stay where they are and meet the at most ``HOT`` rows of ``one`` by broadcast; so no task gets more of one key than 1 in
    ``HOT``. ``count`` is a column of ``one`` that says how often the key occurs in ``many`` (it is dropped). ``many`` is read
    several times: store it. Null keys match nothing.
    """
    total = many.count()
    if count:
        hot = one.filter(F.col(count) * HOT > total).select(key)
        one = one.drop(count)
    else:
        hot = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT > total).select(key)
    names = [r[0] for r in hot.collect()]  # HOT at most
    if not names:
        return many.join(one, key, how)
    hot = F.broadcast(many.sparkSession.createDataFrame([(x,) for x in names], many.select(key).schema))
    cold = many.join(hot, key, "left_anti").join(one, key, how)
    return cold.unionByName(many.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how))


def sized(amount: int, per: int, bits: tuple[int, int]) -> int:
    """A power of two near ``amount / per``, between 2**bits[0] and 2**bits[1]."""
    return 1 << min(max(bits[0], (amount // per).bit_length()), bits[1])


#: Bytes of a filter that travel as one row.
SLAB = 1 << 10


def bit_filter(keys: DataFrame, size: int) -> np.ndarray:
    """A bit for each value of the long column ``tk`` modulo ``size``: of a fixed size, for Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[(batch.column("tk").to_numpy().view(np.uint64) % np.uint64(size)).astype(np.int64)] = True
        packed = np.packbits(bits).reshape(-1, SLAB)
        slabs = np.flatnonzero(packed.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(slabs, pa.int32()), pa.array([packed[i].tobytes() for i in slabs], pa.binary())], ["slab", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column("slab").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(bits, np.uint8)
                total[i] = total[i] | x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slab", "bits"])

    out = np.zeros((size // 8 // SLAB, SLAB), np.uint8)
    for r in keys.mapInArrow(run, "slab int, bits binary").repartition("slab").mapInArrow(join, "slab int, bits binary").toLocalIterator():  # a row for each slab
        out[r.slab] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the 64-bit keys may be one that the filter was made of."""
    at = keys.view(np.uint64) % np.uint64(8 * len(bits))
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null and empty texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
