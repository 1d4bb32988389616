import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.chunked_bpe import Decoder, Encoder, core, cores, cuts, decode, digests, encode, op5_bpe
from tessera.llm.packing import directions, hilbert, mean_direction, pack
from tessera.llm.tokens import ODD as ODD_CHARS
from tessera.llm.tokens import UnitEncoder
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed=1):
    r = random.Random(seed)
    signs = "abc AB'sS\n\t .,!'t've 12é́ßİ\x1c 中Σ٣½ªº_-–“"
    out = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(600)]
    shared = ["".join(r.choice("abcdefgh ing tion. ") for _ in range(3000)) for _ in range(3)]
    out += [f"{r.random()}{r.choice(shared)}{r.random()}" for _ in range(30)]
    return [*(t or "" for t in ODD), *out]


def test_encoders_equal_the_library(library):
    some = texts()
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    units = UnitEncoder(PATH, limit=400)
    for e in (units, Encoder(units)):
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(some)] == want
    assert len(units.known) <= 400 and len(units.trial) <= 100
    d = Decoder(units)
    assert [d.text(np.array(x, dtype=int)) for x in want[:100]] == [library.decode(x, skip_special_tokens=False) for x in want[:100]]


def multilingual(seed=3):
    """Texts that are mostly outside the fast path, long enough for several chunks."""
    r = random.Random(seed)
    kinds = ["абвгдежзийклмнопрстуфхцчшщъыьэюя АБВГД", "αβγδεζηθικλμνξοπρσςτυφχψωΣ άέ", "的一是不了人我在有他这为之大来以个中上们 。，", "हिन्दी में लिखा गया है ", "العربية نص قصير هنا ", "ไทยภาษาไทย ", "한국어 문장 입니다 ", "e\u0301 a\u0308 İstanbul ıI ß ﬁ Å \u3000 \x85 \u2028 ", "\U0001f600\U0001f468\u200d\U0001f469 ok "]
    return ["".join(r.choice(k) if r.random() < 0.95 else r.choice(" \n\t") for _ in range(r.randrange(200, 6000))) for k in kinds for _ in range(4)]


def test_odd_characters_take_the_same_way(library):
    some = multilingual()
    units = UnitEncoder(PATH)
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in Encoder(units).encode(some)] == want
    assert sum(len(cores(t.encode())) > 1 for t in some) > 10


def test_cores_do_not_depend_on_what_is_around():
    assert core(b"abc") is None and core(b" abc") is None and core(b"ab cd") is None and core(b"  \n") is None
    assert core(b"ab cd ef") == (3, 5) and core(b" cd ") == (1, 3) and core(b"x cd\n") == (2, 4) and core(b" cd ef gh") == (1, 6)


def test_joins_widen_until_both_encodings_agree():
    """With a library that goes wrong on windows of few units, the windows must grow."""

    class Library:
        def encode(self, texts):
            return [np.array([x for u in t.split() for x in range(len(u))], "<u2").tobytes() for t in texts]

        def library(self, texts):
            return [x if len(t.split()) >= 7 else bytes(b ^ 255 for b in x) for t, x in zip(texts, self.encode(texts), strict=True)]

    e = Encoder(Library())
    r = random.Random(4)
    for _ in range(20):
        t = " ".join(r.choice(["aa", "bbb", "xc", "xdd", "longer", "x"]) for _ in range(3000))
        assert len(cores(t.encode())) > 3
        assert e.encode([t]) == Library().library([t])


def test_fast_path_agrees_on_every_character_it_takes(library):
    e = UnitEncoder(PATH)
    some = [t for c in map(chr, range(0x20, 0x2100)) if not ODD_CHARS.search(c) for t in (f"a{c}b 1{c}{c}", f"{c}'s 'S{c} x {c} y")]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(some)] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_cuts_follow_content():
    r = random.Random(2)
    body = "".join(r.choice("abcdef ghi") for _ in range(20000)).encode()
    a, b = cuts(body), cuts(b"something else before " + body)
    assert len(a) > 5 and {x + 22 for x in a[2:]} <= set(b)
    assert cuts(b"") == []


def test_queries_round_trip(spark, documents, library):
    r = random.Random(5)
    passage = " ".join(f"Shared{r.randrange(999)} passage" for _ in range(400))
    some = [*texts(5)[:150], *multilingual()[::3], *(f"{r.random()} words before {passage} and after {r.random()}" for _ in range(12)), passage, passage, passage * 3]
    df = documents(some, [(None, passage, "en", "s", 1), (3, "repeated id", "en", "s", 1)])
    ids = sorted(((x.doc_id, x.ids) for x in encode(df, PATH).collect()), key=repr)
    given = [*enumerate(some), (None, passage), (3, "repeated id")]
    assert ids == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in given), key=repr)
    back = sorted(((x.doc_id, x.text) for x in decode(encode(df, PATH), PATH).collect()), key=repr)
    assert back == sorted(((i, library.decode(x, skip_special_tokens=False)) for i, x in ids), key=repr)
    assert digests(documents([]), PATH).collect() == []


def test_whole_query_equals_the_library(spark, library):
    import hashlib

    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in op5_bpe(spark, sf).collect()}
    want = {}
    for d in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_repeated_chunks_go_one_way_and_come_back(library):
    from tessera.llm.chunked_bpe import put_together

    r = random.Random(6)
    passage = " ".join(f"w{r.randrange(10**5)}" for _ in range(2000))
    some = [f"{i} x {passage} y {i}" for i in range(20)]
    e = Encoder(UnitEncoder(PATH))
    pieces, chunks = e.pieces(some, np.full(1 << 17, 255, np.uint8))  # a full filter: every chunk goes
    refs = [x for p in pieces for x in p if isinstance(x, tuple)]
    assert len(refs) > 19 * len(chunks) * 0.7 and {x[0] for x in refs} == set(chunks)
    ids = dict(zip(chunks, e.units.encode([x.decode() for x in chunks.values()])))
    back = [put_together([(ids[x[0]], *x[1:]) if isinstance(x, tuple) else x for x in p]) for p in pieces]
    assert back == e.units.library(some)
    assert not e.pieces(some, np.zeros(1 << 17, np.uint8))[1]
    with pytest.raises(ValueError, match="agree"):
        put_together([(b"\1\0", 0, 0, b"\2\0", b"")])


def test_hilbert_neighbours_are_adjacent():
    import itertools

    points = np.array(list(itertools.product(range(8), repeat=3)))
    path = points[np.argsort(hilbert(points, 3))]
    assert sorted(hilbert(points, 3)) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_lanes_add_up():
    towards = directions(500)
    for n in (1, 70, 200_000):
        ids = np.random.default_rng(n).integers(0, 500, n)
        want = [np.mean([1 if t >> (16 * d) & 1 else -1 for t in towards[ids].tolist()]) for d in range(4)]
        assert mean_direction(towards, ids) == pytest.approx(want)


def test_packing_keeps_each_id_once(spark, documents, library):
    some = texts(7)[:150] + ["long text here " * 3000]
    extra = [(None, "null id", "en", "s", 1), (3, "repeated id", "en", "s", 1)]
    rows = [r.asDict() for r in pack(documents(some, extra), PATH, size=64).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        wide = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert zlib.crc32(wide.tobytes()) == r["ids_crc32"] and len(wide) == r["length"] > 0
    for i, t in enumerate(some):
        if i == 3:
            continue
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for p in pieces for x in np.frombuffer(p["ids"], "<u2").tolist()]
        assert ids == library.encode(t, add_special_tokens=False).ids + [1]
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    assert sum(r["start"] == 0 for r in by_doc[3]) == 2 and None in by_doc
    for k, s in by_seq.items():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:j]) for j in range(len(s))]
        assert sum(r["length"] for r in s) == 64 or k == max(by_seq)
    assert pack(documents([]), PATH).collect() == []


def test_whole_packing_query_equals_the_library(spark, library):
    import pyarrow.parquet as pq

    from tessera.llm.packing import op6_pack

    sf = "/root/testdata/sf0.001"
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in op6_pack(spark, sf).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    given = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(by_doc) == len(given)
    for d in given:
        ids, at = library.encode(d["text"] or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(by_doc[d["doc_id"]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, pieces in by_seq.items():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == 2048 or k == max(by_seq)
