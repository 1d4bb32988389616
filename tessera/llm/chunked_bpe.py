"""Operator 5: BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over the UTF-8 bytes picks cuts by content, so equal passages get equal chunks wherever they stand.
Chunks are named by digest, and counts of the digests over all texts tell those that occur more than once. Each such chunk is
encoded once, wherever it occurs, and a Spark join on digests brings its ids to all its places; chunks that occur once
are encoded where they are.

What is encoded of a chunk is its core, from its first to its last whole unit between white space, which does not depend on
what stands around the chunk. Between two cores lies a join: the text's own units there are cut by the chunks. A join is
repaired by re-encoding it with the library together with the last unit of the core before and the first unit of the core
after it: where the ids of both are those that the cores have for them, both encodings agree and the ids between them are
put in. Where they don't, the window gets twice as many units of the cores, until it agrees or is the whole text. A chunk
without a whole unit is part of a join.

Steps: (1) cut and count the digests; a bit filter, sized by the text up to 16 MB, holds the repeated ones; (2) read the
texts again and repair the joins; chunks outside the filter are encoded there, and texts of such chunks alone are done;
(3) the others, by digest: keep one of each, encode it; (4) join the references with the ids, and put texts together in
order. Where the filter is full, more chunks take the longer way, and none is lost. Texts don't travel, only repeated chunks do.

Defined results: a null or empty text has no ids and decodes to the empty text; rows are independent, so repeated rows and
ties give equal results, null and repeated doc_ids a row each; an empty table gives no rows; other columns are not read.
Equal 128-bit digests are taken as equal chunks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, dealt_join, in_filter, sized, stored, table
from tessera.llm.tokens import UnitEncoder, unit_encoder

#: Cuts fall about every 2**CHUNK_BITS bytes.
CHUNK_BITS, WINDOW_BITS = 10, 16
#: Texts that a task encodes at once.
BATCH = 512
#: Bits of the size of the filter of repeated chunks, least and most: a bit for each ``PER_BIT`` bytes of text.
FILTER, PER_BIT = (20, 27), 32
#: Chunks that a task remembers to have sent.
SENT = 200_000


@functools.cache
def gear(seed: int = 5) -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash h = 2h + g(byte) modulo 2**32 at each byte; its low 16 bits depend on the last 16 bytes alone."""
    h = gear()[np.frombuffer(data, dtype=np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            h[shift:] += h[:-shift] << np.uint32(shift)  # the right side is evaluated first
    return h


def cuts(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of content-defined chunks, without 0 and with len(data); never inside a UTF-8 sequence."""
    if not data:
        return []
    h = gear_hashes(data)
    at = np.flatnonzero((h >> np.uint32(WINDOW_BITS - bits)) & np.uint32((1 << bits) - 1) == 0) + 1
    raw = np.frombuffer(data, dtype=np.uint8)
    at = at[at < len(data)]
    at = at[(raw[at] & 0xC0) != 0x80]
    return [*at.tolist(), len(data)]


def core(chunk: bytes) -> tuple[int, int] | None:
    """Where the whole units of a chunk begin and end, by the chunk alone; None if it has none."""
    head = 0 if chunk[0] <= 32 and chunk[:1].isspace() else len(chunk.split(None, 1)[0])
    rest = chunk[head:]
    inner = rest.rstrip() if rest[-1:].isspace() else rest[: len(rest) - len(rest.rsplit(None, 1)[-1])].rstrip() if rest else b""
    start = len(inner) - len(inner.lstrip())
    return (head + start, head + len(inner)) if inner and start < len(inner) else None


def cores(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of the core of each chunk that has one."""
    out, at = [], 0
    for end in cuts(data):
        c = core(data[at:end])
        if c:
            out.append((at + c[0], at + c[1]))
        at = end
    return out


def name(chunk_core: bytes) -> bytes:
    return hashlib.blake2b(chunk_core, digest_size=16).digest()


@dataclass
class Join:
    """The text between two cores, given by their ends: ``low`` of the one before (-1: none), ``high`` of the one after."""

    text: int
    low: tuple[int, int] | None
    high: tuple[int, int] | None
    units: int = 1  # units of each core in the window
    cut: tuple[int, int] = (0, 0)  # ids of the cores, before and after, that the join has instead
    ids: bytes = b""
    agreed: tuple[bytes, bytes] = (b"", b"")  # ids of the units on which both agree


class Encoder:
    """Encodes texts by cores and joins."""

    def __init__(self, units: UnitEncoder):
        self.units = units

    def repaired(self, data: list[bytes], joins: list[Join]) -> set[int]:
        """Fills the joins in; gives the texts whose window is the whole text before it agrees."""
        whole: set[int] = set()
        todo = joins
        while todo:
            windows, edges = [], []
            for j in todo:
                d = data[j.text]
                low, high = d[slice(*j.low)] if j.low else b"", d[slice(*j.high)] if j.high else b""
                b, a = low.rsplit(None, j.units), high.split(None, j.units)
                before, after = b[-j.units :], a[: j.units]
                # what of the cores lies beyond the window; the units that must agree are its outermost
                start = (j.low[0] + (len(low) - len(low[len(b[0]) :].lstrip()) if len(b) > j.units else 0)) if j.low else 0
                end = j.high[1] - (len(a[-1]) if len(a) > j.units else 0) if j.high else len(d)
                windows.append(d[start:end].decode())
                edges.append((before, after))
            found = self.units.library(windows)
            each = [u.decode() for b, a in edges for u in (*b, *a)]
            own = iter(self.units.encode(each))
            again = []
            for j, ids, (before, after) in zip(todo, found, edges, strict=True):
                b, a = [next(own) for _ in before], [next(own) for _ in after]
                left, right = b[0] if b else b"", a[-1] if a else b""
                if ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right):
                    j.cut = (sum(map(len, b[1:])) // 2, sum(map(len, a[:-1])) // 2)
                    j.ids, j.agreed = ids[len(left) : len(ids) - len(right)], (left, right)
                elif (not j.low or len(before) < j.units) and (not j.high or len(after) < j.units):
                    whole.add(j.text)
                else:
                    j.units *= 2
                    again.append(j)
            todo = again
        return whole

    def pieces(self, texts: list[str], repeated: np.ndarray | None = None) -> tuple[list[list], dict[bytes, bytes]]:
        """(per text its pieces in order, cores by name of the chunks that are to be encoded elsewhere).

        A piece is ids, or (name, ids to drop in front, and at the end, ids that must then come first, and last) of a chunk that
        the filter ``repeated`` has.
        """
        data = [t.encode() for t in texts]
        split = [cores(d) for d in data]
        joins = [Join(i, here[n - 1] if n else None, here[n] if n < len(here) else None) for i, here in enumerate(split) for n in range(len(here) + 1)]
        whole = self.repaired(data, joins)
        for j, after in zip(joins, joins[1:], strict=False):  # windows that meet within a core leave nothing of it
            if j.high and j.units + after.units > 2 and j.units + after.units > len(data[j.text][slice(*j.high)].split()) + 1:
                whole.add(j.text)
        every = [(i, n) for i, here in enumerate(split) if i not in whole for n in range(len(here))]
        names: dict[tuple[int, int], bytes] = {}
        if repeated is not None and every:
            named = [name(data[i][slice(*split[i][n])]) for i, n in every]
            away = in_filter(repeated, np.frombuffer(b"".join(x[:8] for x in named), np.int64))
            names = {at: x for at, x, on in zip(every, named, away.tolist(), strict=True) if on}
        own = [at for at in every if at not in names]
        ids = dict(zip(own, self.units.encode([data[i][slice(*split[i][n])].decode() for i, n in own]), strict=True))
        out: list[list] = [[] for _ in texts]
        at = iter(joins)
        for i, here in enumerate(split):
            mine = [next(at) for _ in range(len(here) + 1)]
            if i in whole:
                out[i] = self.units.library([texts[i]])
                continue
            run = [mine[0].ids]
            for n in range(len(here)):
                how = (mine[n].cut[1], mine[n + 1].cut[0], mine[n].agreed[1], mine[n + 1].agreed[0])
                if (i, n) in ids:
                    run.append(put_together([(ids[i, n], *how)]))
                else:
                    out[i] += [b"".join(run), (names[i, n], *how)]
                    run = []
                run.append(mine[n + 1].ids)
            out[i].append(b"".join(run))
        return out, {x: data[i][slice(*split[i][n])] for (i, n), x in names.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of texts alone."""
        return [b"".join(p) for p in self.pieces(texts)[0]]


def put_together(pieces: list) -> bytes:
    """Ids of a text from its pieces, with the chunks' ids in place of their names."""
    out = []
    for p in pieces:
        if isinstance(p, tuple):
            ids, front, back, first, last = p
            ids = ids[2 * front : len(ids) - 2 * back]
            if not ids.startswith(first) or not ids.endswith(last):
                raise ValueError("a chunk's ids do not agree with its joins")
            out.append(ids)
        else:
            out.append(p)
    return b"".join(out)


class Decoder:
    """decode(ids, skip_special_tokens=False) of a file without a decoder: the tokens, joined by a space."""

    def __init__(self, encoder: UnitEncoder):
        t = encoder.tokenizer
        if t.decoder is not None:
            raise ValueError("this file has a decoder of its own")
        tokens = [t.id_to_token(i) for i in range(t.get_vocab_size())]
        self.tokens = np.array(tokens, dtype=object)
        self.decimal = np.array([str(i) for i in range(len(tokens))], dtype=object)

    def text(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids].tolist())

    def digits(self, ids: np.ndarray) -> str:
        return " ".join(self.decimal[ids].tolist())


def chunk_names(docs: DataFrame) -> DataFrame:
    """(tk): the first 64 bits of the name of each chunk with a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = ((t or "").encode() for t in batch.column("text").to_pylist())
            names = b"".join(name(d[a:b])[:8] for d in data for a, b in cores(d))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64))], ["tk"])

    return docs.select("text").mapInArrow(run, "tk long")


Finish = Callable[[list[bytes]], list[pa.Array]]
PIECES = {"row": pa.int64(), "doc_id": pa.int64(), "pos": pa.int32(), "d": pa.binary(), "ids": pa.binary(), "front": pa.int32(), "back": pa.int32(), "first": pa.binary(), "last": pa.binary()}


def coded(docs: DataFrame, path: str, finish: Callable[[], Finish], schema: str) -> DataFrame:
    """doc_id and the columns of ``schema``, which ``finish()`` of a task makes of its texts' ids."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    size = sized(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PER_BIT, FILTER)
    repeated = bit_filter(chunk_names(docs).groupBy("tk").count().filter("count > 1").select("tk"), size)
    names = list(PIECES)
    of_pieces = "row long, doc_id long, pos int, d binary, ids binary, front int, back int, first binary, last binary"
    done_names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made, sent = Encoder(unit_encoder(path)), finish(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                pieces, chunks = encoder.pieces([t or "" for t in batch.column("text").to_pylist()], repeated)
                chunks = {k: v for k, v in chunks.items() if k not in sent}
                if len(sent) > SENT:
                    sent.clear()  # a chunk may be sent twice; one is kept
                sent.update(chunks)
                open_ = [any(isinstance(x, tuple) for x in p) for p in pieces]
                done = [i for i, x in enumerate(open_) if not x]
                left = [(i, pos, *(x if isinstance(x, tuple) else (x, None, None, None, None))) for i, p in enumerate(pieces) if open_[i] for pos, x in enumerate(p) if x]
                named = [x[3] is not None for x in left]
                owner = pa.array([x[0] for x in left], pa.int64())
                columns = {
                    "row": batch.column("row").take(owner),
                    "doc_id": batch.column("doc_id").take(owner),
                    "pos": [x[1] for x in left],
                    "d": [x[2] if on else None for x, on in zip(left, named, strict=True)],
                    "ids": [None if on else x[2] for x, on in zip(left, named, strict=True)],
                    **{c: [x[k] for x in left] for k, c in enumerate(("front", "back", "first", "last"), 3)},
                }
                of_done = {"doc_id": batch.column("doc_id").take(pa.array(done, pa.int64()))}
                of_chunks = {"d": list(chunks), "ids": list(chunks.values())}
                kind = pa.array([0] * len(done) + [1] * len(left) + [2] * len(chunks), pa.int8())
                parts = lambda c, t: [pa.nulls(n, t) if c not in have else have[c] if isinstance(have[c], pa.Array) else pa.array(have[c], t) for have, n in ((of_done, len(done)), (columns, len(left)), (of_chunks, len(chunks)))]
                ends = [pa.concat_arrays([x, pa.nulls(len(left) + len(chunks), x.type)]) for x in made([b"".join(pieces[i]) for i in done])]
                yield pa.RecordBatch.from_arrays([kind, *(pa.concat_arrays(parts(c, t)) for c, t in PIECES.items()), *ends], ["kind", *names, *done_names])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_encoder(path)
        for batch in batches:
            ids = units.encode([x.decode() for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(ids, pa.binary())], ["d", "ids"])

    out = stored(docs.mapInArrow(run, f"kind byte, {of_pieces}, {schema}"), "coded")
    done = out.filter("kind = 0").select("doc_id", *done_names)
    chunks = stored(out.filter("kind = 2").groupBy("d").agg(F.first("ids").alias("ids")).mapInArrow(encoded, "d binary, ids binary"), "chunk-ids")
    left = out.filter("kind = 1").select(*names)
    pieces = left.filter("d is null").unionByName(dealt_join(left.filter("d is not null").drop("ids"), chunks, "d"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, doc, held, ready = finish(), None, None, [], []

        def given():
            ids, docs_of = [put_together(p) for _, p in ready], [d for d, _ in ready]
            return pa.RecordBatch.from_arrays([pa.array(docs_of, pa.int64()), *made(ids)], ["doc_id", *done_names])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                at, of, _, d, ids, front, back, first, last = row
                if at != now:
                    if held:
                        ready.append((doc, held))
                    now, doc, held = at, of, []
                held.append(ids if d is None else (ids, front, back, first, last))
            if len(ready) >= BATCH:
                yield given()
                ready = []
        if held:
            ready.append((doc, held))
        yield given()

    rest = pieces.select(*names).repartition("row").sortWithinPartitions("row", "pos").mapInArrow(assemble, f"doc_id long, {schema}")
    return done.unionByName(rest)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>): the ids of each text."""

    def finish() -> Finish:
        def of(texts: list[bytes]) -> list[pa.Array]:
            ids = [np.frombuffer(x, dtype="<u2") for x in texts]
            return [pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate([*ids, np.empty(0, "<u2")]).astype(np.int32)))]

        return of

    return coded(docs, path, finish, "encoded array<int>").withColumnRenamed("encoded", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the decoded text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(unit_encoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = some.column("ids")
                texts = [decoder.text(np.array(x.as_py() or [], dtype=np.int64)) for x in ids]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text: its ids are encoded, and decoded from the ids, in one task."""

    def finish() -> Finish:
        decoder = Decoder(unit_encoder(path))

        def of(texts: list[bytes]) -> list[pa.Array]:
            ids = [np.frombuffer(x, dtype="<u2") for x in texts]
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(decoder.digits(x)) for x in ids], pa.string()), pa.array([sha(decoder.text(x)) for x in ids], pa.string())]

        return of

    return coded(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
