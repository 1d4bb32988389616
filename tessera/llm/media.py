"""Operator 10: media columns by content-defined payload chunking.

A payload is stored as 8-bit mono samples: a 44-byte RIFF/WAVE header, then the samples. A rolling gear hash cuts the
samples by content (``LEAST`` to ``MOST`` bytes) and a digest names each chunk. Counts of digests over all payloads tell which
chunks may occur more than once; these go, by digest, to a table of chunks that has each once. Chunks that occur once are stored with
their file. So the store is two tables in the shared folder: files (header, ordered list of digests, own chunks) and
shared chunks. Reading takes these tables alone: a Spark join brings the shared chunks to the files that list them, the
samples are put together in order, and the digest of every chunk and of the whole is checked.

The digests of repeated chunks reach the writers as a bit filter, sized by the text up to 16 MB; where it is full, more chunks
go the shared way, and none is lost. Files with shared chunks are read once for each different media, as a stream of one
file at a time; others are whole where they are.

Defined results: a null text is an empty payload, which is padded to 64 zero bytes; repeated rows and repeated or null
doc_ids give a row each; an empty table gives no rows; other columns are not read; payloads are whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunked_bpe import gear_hashes
from tessera.llm.common import bit_filter, dealt_join, in_filter, sized, stored, table

LEAST, MASK, MOST, RATE = 1024, (1 << 11) - 1, 65536, 8000
#: Bits of the size of the filter of repeated chunks, least and most: a bit for each ``PER_BIT`` bytes of text.
FILTER, PER_BIT = (20, 27), 32
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or 64 * (not data))


def header_of(n: int) -> bytes:
    """Of 8-bit mono samples."""
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples_of(media: bytes) -> bytes:
    """The samples of a stored form, by its header."""
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or len(media) != HEADER.size + n or size != 36 + n:
        raise ValueError("not the stored form")
    return media[HEADER.size :]


def chunk_ends(data: bytes) -> list[int]:
    """Content-defined ends; every chunk but the last has LEAST to MOST bytes."""
    if len(data) <= LEAST:
        return [len(data)]
    at = np.flatnonzero(((gear_hashes(data) >> np.uint32(16)) & np.uint32(MASK)) == 0) + 1
    ends, last = [], 0
    while len(data) - last > LEAST:
        k = np.searchsorted(at, last + LEAST)
        end = min(int(at[k]) if k < len(at) else len(data), last + MOST, len(data))
        ends.append(end)
        last = end
    if last < len(data):
        ends.append(len(data))
    return ends


def features(samples: bytes) -> str:
    """Mean, root mean square around 128, zero crossings and the shares of eight levels."""
    x = np.frombuffer(samples, dtype=np.uint8)
    wave = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    levels = np.bincount(x >> 5, minlength=8)
    return f"mean={x.mean():.4f};rms={np.sqrt((wave.astype(np.float64) ** 2).mean()):.4f};zero={crossings};levels={','.join(map(str, levels.tolist()))}"


def digests_of(data: bytes) -> list[tuple[bytes, int, int]]:
    """(digest, begin, end) of each chunk, in order."""
    ends = chunk_ends(data)
    return [(hashlib.sha256(data[a:b]).digest(), a, b) for a, b in zip([0, *ends], ends, strict=False)]


def chunk_names(docs: DataFrame) -> DataFrame:
    """(tk): the first 64 bits of the digest of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = b"".join(d[:8] for t in batch.column("text").to_pylist() for d, _, _ in digests_of(payload_of(t)))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64))], ["tk"])

    return docs.select("text").mapInArrow(run, "tk long")


FILE = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "media_sha256": pa.string(), "header": pa.binary(), "digests": pa.list_(pa.binary()), "own": pa.list_(pa.binary())}
CHUNK = {"digest": pa.binary(), "packed": pa.binary()}
FILE_ROW = "doc_id long, n_bytes long, payload_bytes long, media_sha256 string, header binary, digests array<binary>, own array<binary>"


def written(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """A row for each file (with ``own`` the packed chunks, null where a chunk is shared), and one for each shared chunk of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sent = zstandard.ZstdCompressor(level=6), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                files: dict[str, list] = {c: [] for c in FILE}
                chunks: dict[bytes, bytes] = {}
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    data = payload_of(text)
                    mine, header = digests_of(data), header_of(len(data))
                    away = in_filter(repeated, np.frombuffer(b"".join(d[:8] for d, _, _ in mine), np.int64)).tolist()
                    for (d, a, b), on in zip(mine, away, strict=True):
                        if on and d not in sent:
                            if len(sent) >= 200_000:
                                sent.clear()  # a chunk may be sent twice; one is kept
                            sent.add(d)
                            chunks[d] = packer.compress(data[a:b])
                    own = [None if on else packer.compress(data[a:b]) for (_, a, b), on in zip(mine, away, strict=True)]
                    row = (doc, len((text or "").encode()), len(data), hashlib.sha256(header + data).hexdigest(), header, [d for d, _, _ in mine], own)
                    for c, v in zip(FILE, row, strict=True):
                        files[c].append(v)
                n, m = batch.num_rows, len(chunks)
                cols = [pa.concat_arrays([pa.array(files[c], t), pa.nulls(m, t)]) for c, t in FILE.items()]
                cols += [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for (_, t), x in zip(CHUNK.items(), (list(chunks), list(chunks.values())), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, [*FILE, *CHUNK])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{FILE_ROW}, digest binary, packed binary")


def write_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tables: files (a row for each of ``docs``) and shared chunks (digest, packed), each once."""
    size = sized(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PER_BIT, FILTER)
    repeated = bit_filter(chunk_names(docs).groupBy("tk").count().filter("count > 1").select("tk"), size)
    rows = stored(written(docs, repeated), "media", codec="lz4")
    chunks = rows.filter("digest is not null").groupBy("digest").agg(F.first("packed").alias("packed"))
    return rows.filter("digest is null").select(*FILE), stored(chunks, "chunks", codec="uncompressed")


READ = {"payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "read_sha256": pa.string(), "feature": pa.string()}
READ_ROW = "payload_sha256 string, tail_crc32 long, media_bytes long, read_sha256 string, feature string"


def read_one(name: str, header: bytes, chunks: list[bytes]) -> tuple:
    """The values of a file from its stored parts, checked."""
    media = header + b"".join(chunks)
    samples = samples_of(media)
    if hashlib.sha256(media).hexdigest() != name:
        raise ValueError(f"media {name} is damaged")
    return hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)


def unpacked(unpacker: zstandard.ZstdDecompressor, packed: bytes, digest: bytes) -> bytes:
    data = unpacker.decompress(packed)
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("a chunk is damaged")
    return data


def read_whole(files: DataFrame) -> DataFrame:
    """Files that have all their chunks, with the values read from them."""
    keep = [c for c in FILE if c not in ("header", "own", "digests")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                columns = (batch.column(c).to_pylist() for c in ("media_sha256", "header", "digests", "own"))
                rows = [read_one(name, header, [unpacked(unpacker, p, d) for p, d in zip(own, digests, strict=True)]) for name, header, digests, own in zip(*columns, strict=True)]
                parts = [len(x) for x in batch.column("digests").to_pylist()]
                values = [pa.array([r[k] for r in rows], t) for k, t in enumerate(READ.values())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *values, pa.array(parts, pa.int32())], [*keep, *READ, "n_chunks"])

    return files.mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, media_sha256 string, {READ_ROW}, n_chunks int")


def read_media(pieces: DataFrame) -> DataFrame:
    """(media_sha256 and the values) of files put together from (media_sha256, seq, payload_bytes, header, digest, packed) that come in
    order; the header is that of the first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, now, top, held, left = zstandard.ZstdDecompressor(), None, b"", [], 0
        for batch in batches:
            out = []
            for name, seq, total, header, digest, packed in zip(*(batch.column(c).to_pylist() for c in ("media_sha256", "seq", "payload_bytes", "header", "digest", "packed")), strict=True):
                if name != now:
                    if left:
                        raise ValueError(f"media {now} has too few chunks")
                    now, top, held, left = name, header or b"", [], total
                if seq != len(held):
                    raise ValueError(f"chunk {seq} of media {name} is out of order")
                held.append(unpacked(unpacker, packed, digest))
                left -= len(held[-1])
                if not left:
                    out.append((name, *read_one(name, top, held)))
            if out:
                kinds = [pa.string(), *READ.values()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["media_sha256", *READ])
        if left:
            raise ValueError(f"media {now} has too few chunks")

    return pieces.mapInArrow(run, f"media_sha256 string, {READ_ROW}")


def read_columns(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``media_columns`` from the stored tables alone."""
    out = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("read_sha256").alias("media_sha256"), "feature", "n_chunks"]
    has_all = ~F.exists("own", lambda x: x.isNull())
    whole = read_whole(files.filter(has_all)).select(*out)

    others = files.filter(~has_all)
    each = others.groupBy("media_sha256").agg(*(F.first(c).alias(c) for c in ("payload_bytes", "header", "digests", "own")))
    pieces = each.select("media_sha256", "payload_bytes", "header", F.posexplode(F.arrays_zip("digests", "own")).alias("seq", "c"))
    pieces = pieces.select("media_sha256", "seq", "payload_bytes", F.when(F.col("seq") == 0, F.col("header")).alias("header"), F.col("c.digests").alias("digest"), F.col("c.own").alias("packed"))
    pieces = stored(pieces, "pieces", codec="lz4")
    joined = dealt_join(pieces.filter("packed is null").drop("packed"), chunks, "digest").select(pieces.columns)
    ordered = pieces.filter("packed is not null").unionByName(joined).repartition("media_sha256").sortWithinPartitions("media_sha256", "seq")
    read = stored(read_media(ordered), "read")
    shared = dealt_join(others.select("doc_id", "n_bytes", "payload_bytes", "media_sha256", F.size("digests").alias("n_chunks")), read, "media_sha256")
    return whole.unionByName(shared.select(*out))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks."""
    return read_columns(*write_media(docs))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
