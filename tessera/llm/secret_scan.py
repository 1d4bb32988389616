"""Operator 8 [native]: secret scan with multipart credential linking.

Strong patterns (``assign``, ``access``, ``hex``) are reported as they are. Weak parts (login names, opaque tokens, endpoints) mean
little alone: they are joined by interval with the other parts of their text, strong ones included, and reported only when
the parts that make up a credential stand within ``SCOPE`` code points: an identifier with a secret, a secret with an
identifier or an endpoint, an endpoint with both. Between two parts lie the code points from the end of the earlier one to the
start of the later one, however long the parts are. A weak part within a strong one is no part of its own.

Places come from splitting a text by a pattern: the lengths of the pieces between and of the matches add up, in blocks
of about the square root of their number, so a text of many matches costs little more than its matches. The interval
join is a sort of a text's parts and of its weak parts' reaches by place, and a running maximum of the ends of each role's
parts; no pairs are made. Texts are joined by digest, so equal texts are searched once.

Defined results: null and empty texts have no spans; repeated rows and null doc_ids get their text's spans; equal starts
go by kind in the order of ``KINDS``; an empty table gives no rows; other columns are not read; texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import dealt_join, let, stored, table

SCOPE = 200

#: The strong patterns; kind -> (pattern, length group, least length).
STRONG = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Weak parts: kind -> (pattern, role).
WEAK = {
    "identifier": (r"(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", "identifier"),
    "opaque": (r"[A-Za-z0-9+/_-]{20,}={0,2}", "secret"),
    "endpoint": (r"(?i:https?|ftps?|ssh|jdbc:[a-z]{1,20}|mongodb|postgres(?:ql)?|mysql|redis|amqps?|s3)://[^\x20\x09-\x0D\"'<>]+|(?i:host(?:_?name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:_/-]{3,}", "endpoint"),
}
#: An opaque token mixes these.
MIXED = ["[0-9]", "[A-Z]", "[a-z]"]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, (_, r) in WEAK.items()}
KINDS = [*STRONG, *WEAK]

NONE = "array<struct<start:long,rank:int,end:long>>"


def running(items: Column, zero: Column, step, value, shifted) -> Column:
    """For each item what ``value(state, item)`` gives, where ``state`` folds ``step`` over the items before it.

    Blocks of about sqrt(n) items are folded from ``zero``, as arrays grow by copying; ``shifted(state, state_of_block)`` takes
    a block's state on from the one before it. (array of states before each item; Column functions in, Column out.)
    """

    def block(b: Column) -> Column:
        start = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("seen"))
        return F.aggregate(b, start, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen")))

    def joined(blocks: Column, parts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), zero, lambda t, p: shifted(t, p["state"]))
        return F.flatten(F.transform(parts, lambda p, i: let(before(i), lambda t: F.zip_with(p["seen"], F.get(blocks, i), lambda y, x: value(shifted(t, y), x)))))

    def by(size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))
        return let(blocks, lambda bs: let(F.transform(bs, block), lambda parts: joined(bs, parts)))

    return F.when(F.size(items) > 0, let(F.ceil(F.sqrt(F.size(items))).cast("int"), by))


def found(text: Column, kind: str) -> Column:
    """Spans (start, rank of the kind, end) of leftmost non-overlapping matches, in order, code points, end exclusive."""
    pattern, group, least = STRONG.get(kind) or (WEAK[kind][0], 0, 0)
    rank = F.lit(KINDS.index(kind))

    def spans(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        steps = F.zip_with(matches, between, lambda m, b: F.struct(F.char_length(m).cast("long").alias("size"), F.char_length(b).cast("long").alias("gap")))
        span = lambda at, x: F.struct((at + x["gap"]).alias("start"), rank.alias("rank"), (at + x["gap"] + x["size"]).alias("end"))
        return let(steps, lambda s: running(s, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + x["size"], span, lambda t, y: t + y))

    def kept(matches: Column) -> Column:
        if kind == "opaque":
            return F.filter(spans(matches), lambda x, i: F.get(matches, i).rlike(MIXED[0]) & F.get(matches, i).rlike(MIXED[1]) & F.get(matches, i).rlike(MIXED[2]))
        if not least:
            return spans(matches)
        sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        return let(sizes, lambda g: F.filter(spans(matches), lambda x, i: F.char_length(F.get(g, i)) >= least))

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), kept)
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(NONE))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_strong`` and ``_weak`` (spans) and ``_key``, the digest of texts with weak parts, else null. Columns of
    these names are overwritten."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = F.concat(*(found(text, k) for k in STRONG))
    weak = F.concat(*(found(text, k) for k in WEAK))
    out = docs.withColumn("_strong", F.sort_array(strong)).withColumn("_weak", weak)
    return out.withColumn("_key", F.when(F.size("_weak") > 0, F.sha2(text, 256)))


def linked(parts_of: DataFrame) -> DataFrame:
    """(_key, _linked): the weak spans of each text that complementary parts stand near. Reads ``scanned``'s columns."""
    texts = parts_of.filter("_key is not null").groupBy("_key").agg(F.first("_strong").alias("_strong"), F.first("_weak").alias("_weak"))
    roles = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])))
    parts = texts.select("_key", F.explode(F.concat(F.transform("_strong", lambda s: F.struct(s.alias("span"), F.lit(False).alias("weak"))), F.transform("_weak", lambda s: F.struct(s.alias("span"), F.lit(True).alias("weak"))))).alias("p"))
    parts = parts.select("_key", "p.span", "p.weak", F.element_at(roles, F.col("p.span.rank")).alias("role"))
    before = lambda *by: W.partitionBy("_key").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    strong_to = F.max(F.when(~F.col("weak"), F.col("span.end"))).over(before("span.start", F.desc("span.end"), "weak"))
    parts = parts.withColumn("strong_to", strong_to).filter(~F.col("weak") | F.col("strong_to").isNull() | (F.col("strong_to") < F.col("span.end"))).drop("strong_to")
    # a part comes up at its start, a weak part asks at the end of its reach: of the parts up to there, does one of the role end in reach?
    at = F.array(F.struct(F.col("span.start").alias("pos"), F.lit(False).alias("asks")), F.struct((F.col("span.end") + SCOPE).alias("pos"), F.lit(True).alias("asks")))
    events = parts.withColumn("e", F.explode(at)).filter(~F.col("e.asks") | F.col("weak")).select("*", "e.pos", "e.asks")
    names = ("identifier", "secret", "endpoint")
    met = events.select("_key", "span", "role", "asks", *(F.max(F.when(~F.col("asks") & (F.col("role") == r), F.col("span.end"))).over(before("pos", "asks")).alias(r) for r in names))
    near = {r: F.coalesce(F.col(r) >= F.col("span.start") - SCOPE, F.lit(False)) for r in names}
    whole = F.when(F.col("role") == "identifier", near["secret"]).when(F.col("role") == "secret", near["identifier"] | near["endpoint"]).otherwise(near["identifier"] & near["secret"])
    return met.filter(F.col("asks") & whole).groupBy("_key").agg(F.sort_array(F.collect_list("span")).alias("_linked"))


def with_spans(scan: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Rows of ``scanned``, best stored, with ``_spans``, all spans by start, then kind. ``met`` is ``linked(scan)``, if that is stored."""
    alone = scan.filter("_key is null").withColumn("_spans", F.col("_strong"))
    joined = dealt_join(scan.filter("_key is not null"), linked(scan) if met is None else met, "_key", "left")
    joined = joined.withColumn("_spans", F.sort_array(F.concat("_strong", F.coalesce("_linked", F.array().cast(NONE))))).drop("_linked")
    return alone.unionByName(joined)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Spans up to which pieces are cut from the text itself, where each cut walks the text; beyond, from its characters.
CUTS = 64


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""

    def pieces(cut) -> Column:
        piece = lambda at, s: F.when(s["start"] >= at, F.concat(cut(at, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))
        last = F.aggregate(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]))
        most = lambda a, b: F.greatest(a, b)
        each = running(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]), piece, most)
        return F.concat(F.array_join(each, ""), let(last, lambda at: cut(at, F.char_length(text) - at)))

    few = pieces(lambda at, n: F.substring(text, (at + 1).cast("int"), n.cast("int")))
    many = let(F.split(text, ""), lambda chars: pieces(lambda at, n: F.array_join(F.slice(chars, (at + 1).cast("int"), n.cast("int")), "")))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= CUTS, few).otherwise(many)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = stored(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "secrets")
    count = lambda k: F.size(F.filter("_strong", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return with_spans(scan, stored(linked(scan), "linked")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("_strong")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))
