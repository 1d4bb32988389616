"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator's decisions.

All but the last keep the columns of documents as they are. Filtering stages keep rows in place; a null is never a reason of
its own to drop a row except where the operator's definition says so (a text without words fails the quality base test).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free, let, stage, stored, table, with_rows
from tessera.llm.jaccard import jaccard_rows
from tessera.llm.packing import pack
from tessera.llm.quality_rules import fitted, measures, verdict
from tessera.llm.secret_scan import linked, redacted, scanned, with_spans
from tessera.llm.toxicity import fit_toxicity, with_toxicity


def nested(docs: DataFrame) -> DataFrame:
    """(row, text): whole rows apart, so that an operator's columns can't meet others of their names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the ordinal model calls toxic go. Null and empty texts are not toxic; repeated rows go or stay together; without
    toxic labels, or rows, nothing goes."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    name = free(docs, "_toxicity")
    return with_toxicity(docs, model, name).filter(~F.col(f"{name}.toxic")).drop(name)


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fails the base test (null and empty ones do), or whose posterior is below one half, go; repeated rows go or stay
    together; an empty table gives no rows.

    Texts are measured twice, for the votes and for the verdict: that costs less than a second copy of all texts.
    """
    m = measures(F.col("text"))
    model = fitted(docs, m)
    return docs.filter(let(m, lambda x: verdict(x, model)))  # one expression, so that a filter's many uses don't measure anew


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of least doc_id (null last), then least hash of the text, then the first
    read. Rows are told apart by where they are read, not by doc_id; so a text whose id another text has as well stays unless
    it is a near copy, and rows without words all stay. An empty table gives no rows."""
    file, at = free(docs, "_file"), free(docs, "_at")
    rows = with_rows(docs, file, at)
    plain = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(file).alias("file"), F.col(at).alias("at"))
    found = stored(jaccard_rows(plain, ["doc_id", "file", "at"]), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "file", "at")
    first = found.filter("component is not null").groupBy("component").agg(F.min(order).alias("row")).select("row.file", "row.at")
    kept = first.unionByName(found.filter("component is null").select("file", "at")).select(F.col("file").alias(file), F.col("at").alias(at))
    return rows.join(kept, [file, at], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


@stage
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced; n_chars follows the text. Null and empty texts and texts without secrets stay as they are, so do
    repeated rows, each with its own columns; an empty table gives no rows."""
    scan = stored(scanned(nested(docs)).drop("text"), "scan")
    scan = with_spans(scan, stored(linked(scan.select("_key", "_strong", "_weak")), "linked"))
    hidden = scan.withColumn("text", redacted(F.col("row.text"), F.col("_spans"))).withColumn("changed", F.size("_spans") > 0)

    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("changed"), F.char_length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return hidden.select(*(column(c) for c in docs.columns))


@stage
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that a trainer reads, ids included: a null or empty text is its end id alone, repeated rows and null ids
    are packed row by row, an empty table gives no piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
