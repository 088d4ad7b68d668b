"""The corpus pipeline: language, quality, exact copies, near copies, packing.

Each stage takes what the one before kept, from Parquet in the shared folder,
and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateflux.llm import exact_dedup, langid, near_dedup, packing, quality
from stateflux.llm.common import load, written
from stateflux.llm.queries import BYTE_BPE, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes if its score is below this quantile of its language's training texts, less ROOM times the quantile's distance from their median.
QUANTILE, ROOM = 0.002, 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a known language: those without letters, or less like every profile than the texts it was learned from, go.

    Null and empty texts have no letters and go. Rows are judged one by one by
    their whole texts, however long: repeated ones alike, null ids like others;
    other columns than those of documents are left out. All rows with a language
    teach the profiles and the limits. Languages equally near
    go to the name that sorts first. With no row to
    learn from, none is known and all go; an empty table stays empty. A language
    none of whose own texts is taken for it has no limit, and no text is in it.
    """
    profiles = langid.learned(docs, "text", "lang", F.lit(True))
    training = langid.identified(docs.where(F.col("lang").isNotNull()), profiles, "text", ["lang"])
    limits = training.where(F.col("lang") == F.col("lang_pred")).groupBy("lang").agg(F.percentile_approx("score", [QUANTILE, 0.5], 100_000).alias("q")).collect()
    if not limits:
        return docs.where("false").select(*COLUMNS)
    least = F.create_map(*[F.lit(x) for r in limits for x in (r["lang"], r["q"][0] - ROOM * (r["q"][1] - r["q"][0]))])[F.col("lang_pred")]
    judged = langid.identified(docs, profiles, "text", [c for c in COLUMNS if c != "text"], carry_text=True)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


#: Row numbers that are no doc_id begin here.
OTHERS = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``row``: doc_id, or where that is null or on several rows, OTHERS and more by a hash of id, language and text.

    Rows that are equal in these have one number.
    """
    unsure = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("unsure"), F.lit(True).alias("_many"))
    if unsure.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    parts = [x for c in ("doc_id", "lang", "text") for x in (F.col(c).isNull(), F.col(c))]
    other = F.lit(OTHERS) + F.shiftrightunsigned(F.xxhash64(*parts), 2)
    found = docs.join(unsure, F.col("doc_id") == F.col("unsure"), "left")
    return found.withColumn("row", F.when(F.col("doc_id").isNull() | F.col("_many").isNotNull(), other).otherwise(F.col("doc_id").cast("long"))).drop("unsure", "_many")


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose perplexity is within their language's limits.

    Null and empty texts have no words and stay; a null language is replaced, for
    the judgement, by the predicted one. Rows with null or repeated ids are told
    apart by id, language and text; equal rows are judged alike. Long texts are
    judged whole, a value at a limit is within it. An empty table
    stays empty; without any label of good quality, all rows stay.
    """
    rows = keyed(docs)
    kept = quality.judged(rows, load(spark, sf_dir, "labels"), row="row").where("keep").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id, a null one last; of rows that repeat it, one.

    Which of the rows that have one id and equal texts stays is open where other
    columns differ. Null texts count as empty and are equal. Long texts are
    compared whole; an empty table stays empty.
    """
    # plain columns: rows that repeat are one before they are dealt out, and the join deals them out alike
    own = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    kept = exact_dedup.exact_dedup(docs).where("kept").select(*own, F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select("*", *own, F.sha2(exact_dedup.normalised("text"), 256).alias("sha")).dropDuplicates(["id", "no_id", "sha"])
    return rows.join(kept, ["id", "no_id", "sha"], "left_semi").select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id (five-word shingles, similarity of 0.8).

    Rows whose doc_id is null or on several rows come after all others, by a hash.
    Null and empty texts are near nothing and stay. Rows that are equal in id,
    language and text count as one and stay together. Long texts are compared
    whole. An empty table stays empty.
    """
    rows = keyed(docs)
    kept = near_dedup.near_duplicates(rows, doc_id="row", width=5, percent=80, n_bands=32, rows=4).where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 2048-token sequences; a null or empty text is its end token alone, and an empty table gives no pieces.

    Every row is packed, one that repeats another or has no id too; a long text
    is cut into as many pieces as it takes.
    """
    return packing.pack(docs, *vocabulary(BYTE_BPE), end=1)


STAGES = [("language_id", language), ("quality", good_text), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None
