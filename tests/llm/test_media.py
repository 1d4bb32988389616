import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import media
from tessera.llm.media import chunk_ends, features, header_of, media_columns, payload_of, read_media, samples_of
from tests.llm.conftest import ODD


def texts():
    r = random.Random(3)
    shared = "".join(r.choice("abcdefg hijé") for _ in range(60000))
    return [*ODD, *(f"{r.random()} {shared}" for _ in range(4)), "a" * 64, "b" * 200000, shared, shared]


def test_values_equal_brute_force(spark, documents):
    some = texts()
    rows = {r.doc_id: r for r in media_columns(documents(some)).collect()}
    assert len(rows) == len(some)
    for i, t in enumerate(some):
        raw = (t or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        stored, r = header_of(len(payload)) + payload, rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.tail_crc32) == (len(raw), len(payload), len(stored), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.feature == features(payload)
    assert rows[len(some) - 1].n_chunks > 1


def test_stored_form_is_a_wave_file(tmp_path):
    import wave

    payload = payload_of("some text")
    (tmp_path / "x.wav").write_bytes(header_of(len(payload)) + payload)
    with wave.open(str(tmp_path / "x.wav")) as f:
        assert (f.getsampwidth(), f.getnchannels(), f.readframes(10**6)) == (1, 1, payload)
    with pytest.raises(ValueError):
        samples_of(b"RIFX" + bytes(60))


def test_chunks_are_cut_by_content():
    r = random.Random(1)
    body = bytes(r.randrange(97, 123) for _ in range(300000))
    a = {hashlib.sha256(body[x:y]).digest() for x, y in zip([0, *chunk_ends(body)], chunk_ends(body))}
    other = b"0123456789" * 50 + body
    b = [hashlib.sha256(other[x:y]).digest() for x, y in zip([0, *chunk_ends(other)], chunk_ends(other))]
    assert sum(x in a for x in b) > 0.7 * len(b)
    sizes = [y - x for x, y in zip([0, *chunk_ends(body)], chunk_ends(body))]
    assert all(media.LEAST <= s <= media.MOST for s in sizes[:-1]) and sum(sizes) == len(body)


def test_damage_is_found(spark):
    import zstandard

    data = payload_of("x")
    header = header_of(len(data))
    name = hashlib.sha256(header + data).hexdigest()
    good = (name, 0, len(data), header, hashlib.sha256(data).digest(), zstandard.ZstdCompressor().compress(data))
    bad = (*good[:5], zstandard.ZstdCompressor().compress(b"y" + data[1:]))
    schema = "media_sha256 string, seq int, payload_bytes long, header binary, digest binary, packed binary"
    assert read_media(spark.createDataFrame([good], schema)).count() == 1
    with pytest.raises(Exception, match="damaged"):
        read_media(spark.createDataFrame([bad], schema)).collect()
    with pytest.raises(Exception, match="out of order"):
        read_media(spark.createDataFrame([(name, 1, *good[2:])], schema)).collect()


def test_empty_table_and_clashing_columns(spark, documents):
    assert media_columns(documents([])).collect() == []
    df = documents(["a", None]).withColumn("digests", F.lit(1)).withColumn("media_sha256", F.lit("clash"))
    assert media_columns(df).count() == 2


def test_stored_tables_alone_give_the_media(spark, documents):
    import zstandard

    some = texts()
    files, chunks = media.write_media(documents(some))
    assert all("mapinarrow" not in x._jdf.queryExecution().toString().lower() for x in (files, chunks))
    held = [(bytes(c.digest), bytes(c.packed)) for c in chunks.collect()]
    assert len(dict(held)) == len(held) > 10
    unpack, held = zstandard.ZstdDecompressor().decompress, dict(held)
    own = []
    for f in files.collect():
        stored = bytes(f.header) + b"".join(unpack(held[bytes(d)] if x is None else x) for d, x in zip(f.digests, f.own, strict=True))
        payload = payload_of(some[f.doc_id])
        assert stored == header_of(len(payload)) + payload
        own += [bytes(d) for d, x in zip(f.digests, f.own) if x is not None]
    assert len(set(own)) == len(own) and not held.keys() & set(own)  # each chunk is stored once
    other = files.withColumn("header", F.lit(bytes(44)))
    with pytest.raises(Exception, match="not the stored form"):
        media.read_columns(other, chunks).collect()


def test_a_full_filter_changes_nothing(spark, documents, monkeypatch):
    import numpy as np

    some = texts()[:14]
    want = sorted(map(str, media_columns(documents(some)).collect()))
    monkeypatch.setattr(media, "bit_filter", lambda keys, size: np.full(size // 8, 255, np.uint8))
    assert sorted(map(str, media_columns(documents(some)).collect())) == want


def test_whole_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in media.op10_media(spark, sf).collect()}
    given = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(got) == len(given)
    for d in given:
        payload, r = payload_of(d["text"]), got[d["doc_id"]]
        stored = header_of(len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((d["text"] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.media_bytes, r.media_sha256, r.tail_crc32, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(payload[-64:]), features(payload))
