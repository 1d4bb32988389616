"""Operator 2: n-gram Jaccard join by count vectors in R-trees.

A text's set is its distinct word shingles. The 64-bit hash of a shingle puts it into one of ``GROUPS`` groups; the counts of
a set's groups are a point. The overlap of two sets is at most the sum of their points' coordinate minima, so it is also at
most the sum over the upper corners of two boxes that hold them: an R-tree over the points discards boxes, then
points, and what survives is verified on the sets themselves.

One tree over a corpus would not prune (boxes of hundreds of dimensions all meet) nor fit a task. So trees are built within
blocks that lose no pair: two sets with Jaccard t share one of their first n - ceil(t*n) + 1 shingles in any common order.
The order is rare shingles first, by a count sketch over all documents, sized by their text up to a bound; a wrong count
costs time only.

Texts with equal sets are one node, and blocks of equal members one block. A block of up to ``SMALL`` members is searched by its
R-tree as it is. In a larger one all members are first tried against the member that is in most blocks (a star, linear in
the block), which joins groups of near copies; then only large blocks whose members are still in several components are
searched by R-tree, for pairs across components. So a group of k copies costs about k, no group is held by the driver,
and what is left of a large block is split into pairs of slots of bounded size. Frequent shingles come last in the order,
so such a block holds only sets four fifths of which are as frequent.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; fewer than ``k`` words
are one shingle; rows with a null doc_id count as members without an id; repeated doc_ids are rows of their own; an
empty table gives no rows; other columns are not read; whole texts are read. Equal 64-bit hashes of different shingles, or
of different sets, would count as equal (for 10**6 texts about one chance in 10**7).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, dealt_join, fresh, in_filter, sized, stored, table, tidy
from tessera.llm.components import components

K, PERCENT, GROUPS = 5, 80, 256
#: Bits of the number of the sketch's counters, least and most: one for each ``PER_COUNTER`` bytes of text. The driver gets a byte
#: for each, so 4 MB at most; each task gives two bytes for each, which a task's 128 MB of text bears.
SKETCH, PER_COUNTER, SKETCH_BLOCK = (18, 22), 1024, 1 << 10
#: Bits of the size of the filter that picks texts whose sets are verified, likewise: a bit for each ``PER_BIT`` bytes of text, so 16 MB at most.
FILTER, PER_BIT = (23, 27), 64
#: A shingle whose counter is 2**SALTED times the mean or more is dealt to that many tasks.
SALTED = 6
#: Members of a block that one search holds, most and least (an eighth of the block between them), and points in a leaf.
SLOT, LEAST_SLOT, LEAF = 4096, 256, 32
#: Members up to which a block is searched without a star.
SMALL = 16

ODDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and [\x20\x09-\x0D] only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    total = np.full(len(h) - size + 1, np.uint64(size))
    for j in range(size):
        total += mixed(h[j : len(h) - size + 1 + j] + ODDS[j % 8] + np.uint64(j))
    return np.unique(mixed(total))


def counts(hashes: np.ndarray) -> bytes:
    """The point of a set: counts of its groups by the hashes' high bits, after the byte size of a count.

    The groups of a long text are more (an eighth of its shingles), for as many would not tell long texts apart; each of
    ``GROUPS`` is then a run of finer ones.
    """
    bits = max(GROUPS.bit_length() - 1, (len(hashes) // 8).bit_length())
    n = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    n = n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32)
    return bytes([n.itemsize]) + n.tobytes()


def point(data: bytes, groups: int | None = None) -> np.ndarray:
    """The counts, with ``groups`` summed up to that many."""
    x = np.frombuffer(data, np.uint8 if data[0] == 1 else np.uint32, offset=1).astype(np.int32)
    return x if groups is None or groups == len(x) else x.reshape(groups, -1).sum(axis=1, dtype=np.int32)


def overlap_bound(p: bytes, q: bytes) -> int:
    """The sum of coordinate minima, in the finest groups that both points have."""
    x, y = point(p), point(q)
    least = min(len(x), len(y))
    return int(np.minimum(point(p, least), point(q, least)).sum())


def coarse(info: DataFrame) -> DataFrame:
    """(dg, n, point) with ``GROUPS`` groups for every set: what trees are built of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("point").to_pylist():
                x = point(data, GROUPS)
                x = x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32)
                out.append(bytes([x.itemsize]) + x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("dg"), batch.column("n"), pa.array(out, pa.binary())], ["dg", "n", "point"])

    return info.select("dg", "n", "point").mapInArrow(run, "dg long, n long, point binary")


def digest(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def described(docs: DataFrame, k: int, size: int, carry: list[str]) -> DataFrame:
    """Rows of documents (columns to ``carry``, all of them long, dg, n, point) and, with ``slab`` >= 0, slabs of each task's part of
    the sketch of ``size`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        sketch = np.zeros(size, np.uint32)
        names = [*carry, "dg", "n", "point", "slab", "sums"]
        for batch in batches:
            dg, n, points = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                dg.append(digest(s) if len(s) else None)
                points.append(counts(s) if len(s) else None)
                np.add.at(sketch, (s & np.uint64(size - 1)).astype(np.int64), 1)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(dg, pa.int64()), pa.array(n, pa.int64()), pa.array(points, pa.binary()), pa.array([-1] * m, pa.int32()), pa.nulls(m, pa.binary())], names)
        slabs = np.flatnonzero(sketch.reshape(-1, SKETCH_BLOCK).any(axis=1)).tolist()
        for at in range(0, len(slabs), 1024):
            some = slabs[at : at + 1024]
            m = len(some)
            sums = [np.minimum(sketch[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK], 65535).astype(np.uint16).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in [*carry, "dg", "n"]), pa.nulls(m, pa.binary()), pa.array(some, pa.int32()), pa.array(sums, pa.binary())], names)

    return docs.mapInArrow(run, f"{''.join(f'{c} long, ' for c in carry)}dg long, n long, point binary, slab int, sums binary")


def levels(slabs: DataFrame, size: int) -> np.ndarray:
    """How frequent each counter's shingles are: 0 up to the mean, one more for each doubling; a byte for each counter."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column("slab").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(sums, np.uint16).astype(np.int64)
                total[i] = total[i] + x if i in total else x
        sums = [int(x.sum()) for x in total.values()]
        # logs in eighths, so that a counter fits in a byte
        logs = [np.round(8 * np.log2(np.maximum(x, 1))).clip(0, 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums, pa.int64()), pa.array(logs, pa.binary())], ["slab", "total", "logs"])

    out, total = np.zeros(size, np.uint8), 0
    for r in slabs.select("slab", "sums").repartition("slab").mapInArrow(add, "slab int, total long, logs binary").toLocalIterator():  # a row for each slab
        out[r.slab * SKETCH_BLOCK : (r.slab + 1) * SKETCH_BLOCK] = np.frombuffer(r.logs, np.uint8)
        total += r.total
    mean = np.log2(max(1.0, total / size))
    return np.floor(np.maximum(out / np.float32(8) - np.float32(mean), 0) + np.float32(0.1)).astype(np.uint8)


def prefixes(docs: DataFrame, level: np.ndarray, k: int, percent: int) -> DataFrame:
    """(h, salt, dg): the first shingles of each set, rare ones first; ``salt`` deals frequent ones, else it is -1."""
    mask = np.uint64(len(level) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        sent: set[int] = set()
        for batch in batches:
            heads, salts, owners = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for text in batch.column("text").to_pylist():
                s = shingles(text, k)
                if not len(s) or (dg := digest(s)) in sent:
                    continue
                if len(sent) >= 300_000:
                    sent.clear()  # a set may be sent twice; that does no harm
                sent.add(dg)
                size = len(s) + (-percent * len(s) // 100) + 1
                often = level[(s & mask).astype(np.int64)]
                order = np.argsort((often.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6)), kind="stable")[:size]
                heads.append(s[order].view(np.int64))
                salts.append(np.where(often[order] >= SALTED, dg % (1 << np.minimum(often[order], 30).astype(np.int64)), -1).astype(np.int32))
                owners.append(np.full(size, dg, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (heads, salts, owners)], ["h", "salt", "dg"])

    return docs.mapInArrow(run, "h long, salt int, dg long")


def shared(posts: DataFrame) -> DataFrame:
    """The distinct (h, dg) whose h has more than one dg, or is dealt; a sorted stream, so no block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        held: tuple[int, int, int, bool] | None = None  # the last row, and whether one before shares its h
        for batch in batches:
            h, salt, dg = (batch.column(c).to_numpy() for c in ("h", "salt", "dg"))
            if held:
                h, salt, dg = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], salt]), np.concatenate([[held[2]], dg])
            if not len(h):
                continue
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (dg[1:] != dg[:-1])])
            h, salt, dg = h[first], salt[first], dg[first]
            same = h[1:] == h[:-1]
            before = np.concatenate([[bool(held and held[3])], same])
            on = ((before | np.concatenate([same, [False]])) | (salt >= 0))[:-1]
            held = (h[-1], salt[-1], dg[-1], bool(before[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(h[:-1][on]), pa.array(dg[:-1][on])], ["h", "dg"])
        if held and (held[3] or held[1] >= 0):
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[2]], pa.int64())], ["h", "dg"])

    return posts.repartition("h", "salt").sortWithinPartitions("h", "salt", "dg").mapInArrow(run, "h long, dg long")


def least_overlap(n, m, percent: int):
    """Overlap at which sets of n and m shingles reach the percentage."""
    return -((-percent * (n + m)) // (100 + percent))


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b, n_a, n_b, point_a, point_b) whose points allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, p, q in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "point_a", "point_b")), strict=True):
                keep.append(100 * min(n, m) >= percent * max(n, m) and overlap_bound(p, q) >= least_overlap(n, m, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


class Tree:
    """Two-level R-tree over points that are sorted into leaves; boxes are upper corners, for that is all the bound needs."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        slab = np.argsort(n, kind="stable")
        width = max(LEAF, int(np.sqrt(len(n) * LEAF)))
        order = [s[np.argsort(points[s, : GROUPS // 2].sum(axis=1), kind="stable")] for s in (slab[i : i + width] for i in range(0, len(n), width))]
        self.leaves = [s[i : i + LEAF] for s in order for i in range(0, len(s), LEAF)]
        self.upper = np.array([points[x].max(axis=0) for x in self.leaves])
        self.least = np.array([n[x].min() for x in self.leaves])
        self.most = np.array([n[x].max() for x in self.leaves])
        self.points, self.n = points, n

    def pairs(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(i, js) of all points that may link, each pair once."""
        for x, mine in enumerate(self.leaves):
            rest = slice(x, None)
            near = (100 * self.most[rest] >= percent * self.least[x]) & (100 * self.most[x] >= percent * self.least[rest])
            near &= np.minimum(self.upper[rest], self.upper[x]).sum(axis=1) >= least_overlap(self.least[x], self.least[rest], percent)
            leaves = np.flatnonzero(near) + x
            if not len(leaves):
                continue
            others = np.concatenate([self.leaves[y] for y in leaves])
            theirs, sizes = self.points[others], self.n[others]
            place = {int(j): at for at, j in enumerate(others[: len(mine)])} if leaves[0] == x else {}
            for i in mine.tolist():
                from_ = place.get(i, -1) + 1  # of the own leaf, only those after this one
                js, m = others[from_:], sizes[from_:]
                ok = (100 * np.minimum(m, self.n[i]) >= percent * np.maximum(m, self.n[i])) & (np.minimum(theirs[from_:], self.points[i]).sum(axis=1) >= least_overlap(self.n[i], m, percent))
                if ok.any():
                    yield i, js[ok]


def searched(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, across components, within each (h, i, j) of sorted rows."""

    def search(rows: dict) -> tuple[list, list]:
        dg, comp, slot = (np.array(rows[c]) for c in ("dg", "component", "slot"))
        n = np.array(rows["n"])
        points = np.array([point(x) for x in rows["point"]])
        hub, across = rows["hub"][0], rows["i"][0] != rows["j"][0]
        a, b = [], []
        for i, js in Tree(points, n).pairs(percent):
            if hub is not None and dg[i] == hub:  # tried with all of its block before
                continue
            js = js[comp[js] != comp[i]]
            if hub is not None:
                js = js[dg[js] != hub]
            if across:
                js = js[slot[js] != slot[i]]
            a += [min(int(dg[i]), int(x)) for x in dg[js]]
            b += [max(int(dg[i]), int(x)) for x in dg[js]]
        return a, b

    names = ["h", "i", "j", "dg", "component", "slot", "n", "point", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        held: dict[str, list] = {c: [] for c in names}

        def give(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in names}
            key = list(zip(cols["h"], cols["i"], cols["j"], strict=True))
            a, b, at = [], [], 0
            last = (held["h"][0], held["i"][0], held["j"][0]) if held["h"] else None
            for e in range(len(key) + 1):
                if e == len(key) or key[e] != last:
                    for c in names:
                        held[c] += cols[c][at:e]
                    at = e
                    if e < len(key):
                        if len(held["h"]) > 1:
                            x, y = search(held)
                            a += x
                            b += y
                        held = {c: [] for c in names}
                        last = key[e]
            if a:
                done = list(dict.fromkeys(zip(a, b, strict=True)))
                yield give([x for x, _ in done], [y for _, y in done])
        if len(held["h"]) > 1:
            yield give(*search(held))

    return blocks.select(*names).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, info: DataFrame, k: int, size: int) -> DataFrame:
    """(dg, s): the shingles of the given nodes (and of few others), made again from their texts where those are.

    A bit filter of ``size`` picks the texts, so texts are never shuffled; where so many nodes are asked for that the filter
    is full, more sets travel, and none is lost.
    """
    bits = bit_filter(info.join(nodes, "dg", "left_semi").select("tk"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        sent: set[int] = set()
        for batch in batches:
            on = in_filter(bits, batch.column("tk").to_numpy())
            dg, sets = [], [np.empty(0, np.int64)]
            for text in batch.column("text").filter(pa.array(on)).to_pylist():
                s = shingles(text, k)
                if len(s) and (d := digest(s)) not in sent:
                    if len(sent) >= 300_000:
                        sent.clear()
                    sent.add(d)
                    dg.append(d)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(dg, pa.int64()), pa.ListArray.from_arrays(np.cumsum([len(x) for x in sets]).astype(np.int32), pa.array(np.concatenate(sets)))], ["dg", "s"])

    return docs.select("text", "tk").mapInArrow(run, "dg long, s array<long>").dropDuplicates(["dg"])


def verified(docs: DataFrame, pairs: DataFrame, info: DataFrame, k: int, percent: int, size: int) -> DataFrame:
    """Those of the stored (a, b) that reach the percentage, by their sets. Both joins read one exchange of the sets."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("dg")).unionByName(pairs.select(F.col("b").alias("dg"))).distinct(), info, k, size)
    left = sets.select(F.col("dg").alias("a"), F.col("s").alias("s_a"))
    right = sets.select(F.col("dg").alias("b"), F.col("s").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    kept = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").filter((100 + percent) * both >= percent * (F.size("s_a") + F.size("s_b")))
    return stored(kept.select("a", "b"), "links")


def jaccard_rows(docs: DataFrame, carry: list[str], k: int = K, percent: int = PERCENT) -> DataFrame:
    """A row for each of ``docs``: the (long) columns to ``carry``, tk (hash of the text), n_shingles and component, a key of the
    group of rows that links join; null for rows without words, which are alone."""
    docs = docs.select(*carry, "text", F.xxhash64("text").alias("tk"))
    carry = [*carry, "tk"]
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sized(chars, PER_BIT, FILTER)
    counters = sized(chars, PER_COUNTER, SKETCH)
    all_rows = stored(described(docs, k, counters, carry), "described")
    rows = all_rows.filter("slab < 0")
    posts = stored(shared(prefixes(docs.select("text"), levels(all_rows.filter("slab >= 0"), counters), k, percent)), "posts")

    info = dealt_join(rows.filter("dg is not null").select("dg", "n", "point", "tk"), posts.select("dg").distinct(), "dg").groupBy("dg").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.min("tk").alias("tk"))
    info = stored(info, "info")
    tidy(docs.sparkSession)
    side = lambda c: info.select(F.col("dg").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}"))

    degree = posts.groupBy("dg").agg(F.count("*").alias("degree"))
    members = (F.count("*").alias("members"), F.sum(F.xxhash64("dg").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("dg", F.lit(2))).alias("xor"))
    blocks = posts.join(degree, "dg").groupBy("h").agg(F.max(F.struct("degree", "dg")).alias("top"), *members).filter("members > 1")
    # blocks of the same members (most shingles that two texts share) are one block
    hubs = stored(blocks.groupBy("members", "sum", "xor").agg(F.min("h").alias("h"), F.first("top.dg").alias("hub")).select("h", "members", "hub"), "hubs")
    held = stored(dealt_join(posts, hubs.withColumn("n", F.col("members")), "h", count="n"), "held")
    least = coarse(info)
    no = lambda kind: F.lit(None).cast(kind)
    small = held.filter(F.col("members") <= SMALL).select("h", "dg", *(F.lit(0).cast("long").alias(c) for c in ("i", "j", "slot")), F.col("dg").alias("component"), no("long").alias("hub")).join(least, "dg")
    stars = held.filter(F.col("members") > SMALL).filter("dg <> hub").select(F.least("dg", "hub").alias("a"), F.greatest("dg", "hub").alias("b"))
    first_pairs = stored(stars.unionByName(searched(small, percent)).distinct(), "pairs")
    tried = stored(bounded(first_pairs.join(side("a"), "a").join(side("b"), "b"), percent), "tried")
    links = verified(docs, tried, info, k, percent, bits)
    tidy(docs.sparkSession)
    first = stored(components(links, "a", "b"), "first")

    named = held.filter(F.col("members") > SMALL).join(first.withColumnRenamed("node", "dg"), "dg", "left").withColumn("component", F.coalesce("component", "dg"))
    named = stored(named, "named")
    open_ = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high").select("h", "n", F.lit(True).alias("open"))
    slots = F.ceil(F.col("members") / F.least(F.greatest(F.col("members") / 8, F.lit(LEAST_SLOT)), F.lit(SLOT)))
    rows_open = dealt_join(named, open_, "h", count="n").join(least, "dg").withColumn("slot", F.pmod(F.xxhash64("dg", F.lit(1)), slots))
    blocks = rows_open.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1))).withColumn("i", F.least("slot", "other")).withColumn("j", F.greatest("slot", "other"))
    tidy(docs.sparkSession)
    may = stored(searched(blocks, percent).distinct().join(tried, ["a", "b"], "left_anti"), "may")
    more = stored(bounded(may.join(side("a"), "a").join(side("b"), "b"), percent), "more")
    tidy(docs.sparkSession)
    links = verified(docs, more, info, k, percent, bits)
    tidy(docs.sparkSession)
    named_a, named_b = (first.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    bridges = links.join(named_a, "a", "left").join(named_b, "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    second = stored(components(bridges, "a", "b"), "second")
    last = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = second.join(first, "node", "left_anti").select("node", "component")
    names = stored(last.unionByName(alone), "names").select(F.col("node").alias("dg"), "component")

    has = rows.filter("dg is not null").select(*carry, "n", "dg")
    placed = dealt_join(has, names, "dg", "left")
    out = placed.unionByName(rows.filter("dg is null").select(*carry, "n", "dg"), allowMissingColumns=True)
    return out.select(*carry, F.col("n").alias("n_shingles"), F.coalesce("component", "dg").alias("component"))


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    rows = stored(jaccard_rows(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], k, percent), "placed")
    sets = rows.filter("component is not null")
    least = sets.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    out = dealt_join(sets, stored(least, "least"), "component", count="n").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.filter("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
