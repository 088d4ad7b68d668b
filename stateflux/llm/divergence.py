"""Source divergence audit: which sources of a language use words unlike each other, and which words stand out."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.llm.common import Work, slices, tidy, written

#: Runs of letters A-Z, a-z and of all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are integers, in parts of this; a language's vocabulary meets its sources in shards of so many terms; a task holds so many counts.
SCALE, SHARD, HELD = 1_000_000_000, 50_000, 400_000


def occurrences(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, d: occurrences of a term and the number of documents with it, of some documents each.

    On UTF-8 the matches of TERM are what blanks separate, once all other ASCII
    characters are blanks. A task passes its counts on when it holds HELD.
    """
    letters = bytes(range(65, 91)) + bytes(range(97, 123))
    plain = bytes((c | 32 if c in letters else 32) if c < 128 else c for c in range(256))
    names = ["lang", "source", "term", "n", "d"]

    def passed(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            d = held[lang, source]
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            key = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([x], pa.string())).cast(pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*key, terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in slices(batches):
            texts, keys = batch.column(2).cast(pa.binary()).to_pylist(), zip(*(batch.column(i).to_pylist() for i in (0, 1)))
            for t, key in zip(texts, keys):
                words, n = t.translate(plain).split(), counts[key]
                size -= len(n)
                n.update(words)
                size += len(n)
                held[key].update(set(words))
            if size > HELD:
                yield from passed(counts, held)
                counts, held, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from passed(counts, held)

    rows = docs.select(_plain(lang).alias("lang"), _plain(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(work), "lang string, source string, term string, n long, d long")


def _plain(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _share(count: str, size: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (size + terms)), exact."""
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0)) div ({size} + {terms})")


def audit(docs: DataFrame, least: int = 3, most: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language, the others by distance (``pair``) and its ``most`` most characteristic terms (``term``).

    1. Terms of whole texts are counted by language and source, within tasks
       before the shuffle; those in at least ``least`` documents of their
       language are kept.
    2. Groups cross their language's kept terms, so that a term that a group
       lacks counts 0. The vocabulary is dealt to shards, to each of which the
       groups are copied: no task gets a language.
    3. Joined with itself on language and term, it gives each two sources of a
       language their shares of the term; sums leave each task once for a pair.

    Null text, language and source are empty strings. Equal rows all count. A
    source without terms, or a language without kept ones, has pairs of value 0
    and no terms. Values tie by the item's bytes. An empty table gives no rows.
    Other columns are ignored, whatever their names. The result has a row for
    each two sources of a language, as many as the square of its sources.
    """
    with Work() as work:
        # dealt by language and term once, for the sums and for the documents over all sources
        counts = occurrences(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        everywhere = Window.partitionBy("lang", "term")  # as many rows as the language has sources
        counts = counts.withColumn("total", F.sum("n").over(everywhere)).withColumn("d", F.sum("d").over(everywhere))
        own = work.written(counts.where(F.col("d") >= least).select("lang", "term", "source", "n", "total"), "kept")
        kept = work.written(own.select("lang", "term", "total").distinct(), "vocabulary")
        languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("nl"))
        sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("ng"))
        found = docs.select(_plain(lang).alias("lang"), _plain(source).alias("source")).distinct()
        groups = found.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["ng", "v", "nl"])
        groups = work.written(groups, "groups")
        shards = max(1, -(-kept.count() // SHARD))
        dealt = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
        copies = groups.where("v > 0").select("lang", "source").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        zeros = dealt.join(copies, ["lang", "shard"]).select("lang", "term", "source", F.lit(0).cast("long").alias("n"), "total")
        dense = zeros.unionByName(own).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
        dense = dense.join(groups, ["lang", "source"])
        shares = dense.select("lang", "term", "source", "n", _share("n", "ng", "v").alias("p"), _share("total", "nl", "v").alias("q"))
        shares = work.written(shares, "shares")
        value = F.expr("(p - q) * (p - q) div q")
        a, b = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
        # both directions of a pair from one joined row
        met = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(value).alias("to"), F.sum(F.expr("(p - q) * (p - q) div p")).alias("back"))
        pairs = met.select("lang", F.inline(F.array(F.struct(F.col("source"), F.col("item"), F.col("to").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
        bare = groups.where("v = 0").select("lang", "source")
        bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
        terms = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        columns = ["lang", "source", "part", "item", "value", "rank"]
        of_pairs = pairs.unionByName(bare).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
        of_terms = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        return written(of_pairs.select(*columns).unionByName(of_terms.select(*columns)), "divergence")
