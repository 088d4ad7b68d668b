"""Exact deduplication: 128-bit content hash, smallest stable id stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import salt, salt_mask, salts_in, written

#: A run of these becomes one blank before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str):
    """A text with every run of blanks as one blank; a null text is an empty one."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


#: Hexadecimal digits of the mark of a hash that several rows have: there are at most 16 ** 5 marks, a million, to be broadcast.
MARK_DIGITS = 5


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    1. A table of every row's id, digest (SHA-256) and length is written.
    2. Rows are counted by the digest's first 128 bits. The first MARK_DIGITS
       digits of the hashes that several rows have, the marks, are broadcast.
    3. Only texts with such a mark are grouped by hash and whole bytes, so a
       collision of hashes cannot join two texts. The grouping sums in each
       task before it shuffles: a text that a third of all rows repeat leaves
       each task once, and a text without a mark stays where it is. (Beyond
       some million groups of copies most marks occur, and every text leaves.)
    4. Rows meet their groups on (digest, length, salt), with the salts a group
       has in a bit mask, so that no task gets all rows of a large group.

    Null text counts as empty. Rows with a null id take part and are kept only
    if their group has no other id. Repeated rows all count, and all rows with
    the smallest id are kept. Long texts are hashed whole. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    rows = rows.select("*", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("size"), salt("doc_id").alias("salt"))
    h128 = F.unhex(F.substring("text_sha256", 1, 32)).alias("h128")
    mark = F.conv(F.substring("text_sha256", 1, MARK_DIGITS), 16, 10).cast("int").alias("mark")
    prints = written(rows.select("doc_id", "text_sha256", "size", "salt"), "digests")
    several = prints.groupBy(h128, mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = rows.withColumn("mark", mark).join(F.broadcast(several.select("mark").distinct()), "mark", "left_semi")  # 16 ** MARK_DIGITS numbers at most
    groups = (
        marked.groupBy(h128, "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), salt_mask("salt").alias("mask"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("size"), "keep_id", "group_size", F.explode(salts_in("mask")).alias("salt"))
    )
    out = prints.join(groups, ["text_sha256", "size", "salt"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
