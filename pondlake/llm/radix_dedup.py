"""Exact dedup by distributed MSD radix partitioning.

A text is split by its length first and then by successive blocks of bytes, from
the first on. A block of bytes is one digit of the radix; blocks widen
(32, 256, 2048, ... bytes), so even a text of gigabytes takes about ten rounds.
After each round a group that has one text left is done, as is a group whose
texts have ended; only open groups go on, with the rest of their bytes. Texts
are compared by their bytes alone, no digest decides.

A round is an aggregate with map-side combine (a group holding a third of all
rows costs one row per task), then a join of its result with the rows, which
Spark's skew join splits. The first round shuffles 32 bytes a document, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import WS, Scratch, keep_rows, sized_join, text_key, text_or_empty

FIRST_BYTES, WIDEN = 32, 8


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), WS + "+", " ")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, text_key``.

    Equal texts (white space runs as one space) form a group. The row with the
    smallest id stays; a null id counts as larger than any other, and of rows
    repeated with the same id one stays. Null text is the empty text. An empty
    table gives an empty result; columns besides id and text are not read.
    ``text_sha256`` is the digest of the normalised text, for reports only;
    ``text_key`` names the text as given.
    """
    scratch = scratch or Scratch(docs.sparkSession, "radix")
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
                         normalised(text_col).cast("binary").alias("body"))
    keyed = source.withColumn("size", F.octet_length("body").cast("long")) \
                  .withColumn("head", F.substring("body", 1, FIRST_BYTES))
    shared = scratch.write(keyed.groupBy("size", "head").count().filter("count > 1").select("size", "head"))
    met = sized_join(keyed, shared.withColumn("met", F.lit(True)), ["size", "head"], "left", 80)
    first = scratch.write(met.select(
        "doc_id", "text_key", F.sha2("body", 256).alias("text_sha256"), "size",
        F.monotonically_increasing_id().alias("row_id"), F.col("met").isNotNull().alias("open"),
        F.when(F.col("met").isNotNull(), F.col("body")).alias("body")))

    alone = first.filter("not open").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "text_key")
    done, rows, width, ended = [alone], first.filter("open").withColumn("grp", F.col("size")), FIRST_BYTES, 0
    while not rows.isEmpty():
        width *= WIDEN
        ended += width
        digit = rows.withColumn("digit", F.substring("body", 1, width))
        # written, so that both sides of the join are plain shuffles, whose large parts Spark splits
        groups = scratch.write(digit.groupBy("grp", "digit").agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("least")))
        split = sized_join(digit, groups, ["grp", "digit"], "inner", width + 64)
        open_ = (F.col("n") > 1) & (F.col("size") > ended)
        rows = scratch.write(split.select(
            "doc_id", "text_key", "text_sha256", "size", "row_id", F.col("least.doc_id").alias("keep_id"),
            F.col("least.row_id").alias("grp"), "n", open_.alias("open"),
            F.when(open_, F.expr(f"substring(body, {width + 1})")).alias("body")))
        done.append(rows.filter("not open").select(
            "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_id") == F.col("grp")).alias("kept"),
            "text_sha256", "text_key"))
        rows = rows.filter("open").select("doc_id", "text_key", "text_sha256", "size", "row_id", "grp", "body")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    scratch = Scratch(docs.sparkSession, "radix")
    return keep_rows(docs, exact_classes(docs, id_col, text_col, scratch), id_col, text_col, scratch)
