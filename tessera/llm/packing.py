"""Operator 6: packing along a space-filling curve.

Each document's token ids are projected to a few dimensions (hashed directions, mean over its ids), the point's Hilbert
key orders all documents, and the ids in that order are one stream that is cut every ``size`` ids. So neighbours on the
curve share sequences, no sequence but the last is shorter than ``size``, and there is no padding inside.

Defined results: a null text is an empty one (its document is the end id alone); repeated rows and repeated or null
doc_ids are packed row by row; ties on the curve go by doc_id, then by row; an empty table gives no piece; other
columns are not read.

Steps: (1) encode, project and store the ids, in one pass; (2) range-sort (key, row, count) alone, which is a few bytes a
row, sum counts within partitions and shift them by the partitions' totals; (3) send each row's place back to its ids
and cut there, row by row. No task holds more than its rows, and the driver gets nothing.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored, table, trim
from tessera.llm.tokens import unit_encoder

DIMS, BITS, SEED = 4, 10, 17


LANE = 16


def directions(size: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """A hashed direction for each token id: a bit for each dimension (set: up, else down), one to a lane of 16 bits."""
    x = np.arange(size * dims, dtype=np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = ((x >> np.uint64(33)) & np.uint64(1)).reshape(size, dims)
    return (bits << (np.arange(dims, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1, dtype=np.uint64)


def mean_direction(towards: np.ndarray, ids: np.ndarray, dims: int = DIMS) -> list[float]:
    """Mean over the ids of their directions, each -1 or 1 in each dimension. All lanes are added at once."""
    most = (1 << LANE) - 1
    up = [0] * dims
    for at in range(0, len(ids), most):  # so that no lane runs over
        total = int(towards[ids[at : at + most]].sum(dtype=np.uint64))
        up = [u + (total >> (LANE * d) & most) for d, u in enumerate(up)]
    return [2 * u / len(ids) - 1 for u in up]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (rows) on the Hilbert curve through the cube of side 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def place(means: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Means of directions to grid points; the middle, where most documents are, gets most cells."""
    return np.clip(((np.tanh(means * 3) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = unit_encoder(path)
        towards = directions(1 << 16)
        last = np.array([end], dtype="<u2").tobytes()
        gc.disable()  # nothing here is cyclic, and the memory of units is large to walk
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    ids = [x + last for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
                    means = np.array([mean_direction(towards, np.frombuffer(x, dtype="<u2")) for x in ids], dtype=np.float64).reshape(-1, DIMS)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hilbert(place(means))), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def places(rows: DataFrame) -> DataFrame:
    """row, pos: the ids before each row in curve order. Only a row for each partition meets in one task."""
    by = ["key", "doc_id", "row"]
    local = stored(rows.select(*by, "n").repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "curve")
    total = local.groupBy("part").agg(F.sum("n").alias("total"))
    shift = total.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("shift"))
    before = F.sum("n").over(W.partitionBy("part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return local.select("part", "row", before.alias("before")).join(shift, "part").select("row", (F.col("before") + F.col("shift")).alias("pos"))


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (int array): the pieces of all documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, pos, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "n", "ids")), strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                at = 0
                while at < n:
                    offset = (pos + at) % size
                    length = min(n - at, size - offset)
                    piece = wide[at : at + length]
                    for x, v in zip(out, (doc, at, length, zlib.crc32(piece.tobytes()), n, (pos + at) // size, offset, ids[2 * at : 2 * (at + length)]), strict=True):
                        x.append(v)
                    at += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for x, c in zip(out, names, strict=True)], names)

    rows = stored(encoded(docs, path, end), "ids")
    return rows.join(places(rows), "row").select("doc_id", "pos", "n", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
