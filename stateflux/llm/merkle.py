"""Merkle manifest: every row's place under one root, a proof for each, and what tampering does to it.

Ranks come from histograms of the ids' digits, level by level, without a global
sort. The digits of a rank in base FANOUT are the path of its leaf in the trie;
nodes are reduced by the longest prefix first, DEEP levels in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stateflux.llm.common import Work, meet, salt, salt_mask, written

#: Children of a node, levels reduced in one shuffle, bits of an id's digit, copies of one row that a task makes, languages in one part.
FANOUT, DEEP, DIGIT, COPIES, PART = 8, 4, 12, 1 << 16, 100_000
CHUNK = FANOUT**DEEP
PATH = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as part of a leaf: its bytes' number, a colon, its text; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """g, h, k, leaf, changed: the language as a key (null first), the id (whether, which), its digest, and the digest after tampering if that is another.

    Tampering lower-cases A-Z of the text where 3 divides the checksum of the id.
    """
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", UPPER, LOWER)
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lowered != F.col("text"))
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("g"),
        F.col("doc_id").isNotNull().cast("int").alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"),
        F.unhex(digest(*head, field(F.col("text")))).alias("leaf"),
        F.when(hit, F.unhex(digest(*head, field(lowered)))).alias("changed"),
    )


def placed(cells: DataFrame, by: list[str], levels: list[str]) -> DataFrame:
    """``cells`` with ``before`` and ``total``: how many rows (column n) of the group precede a cell's, and how many it has.

    ``levels`` are prefixes of the order, from short to long; the longest tells a
    group's cells apart. Histograms of longer prefixes sum to those of shorter
    ones. No window holds more than the children of one prefix.
    """
    tables = [cells]
    for i in range(len(levels) - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(*by, *levels[:i]).agg(F.sum("n").alias("n")))
    out = None
    for i, table in enumerate(tables):
        parent = [*by, *levels[:i]]
        inside = Window.partitionBy(*parent)
        earlier = F.coalesce(F.sum("n").over(inside.orderBy(levels[i]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if out is None:
            out = table.withColumn("before", earlier).withColumn("total", F.sum("n").over(inside))
        else:
            above = out.select(*parent, F.col("before").alias("_above"), "total")
            out = table.withColumn("before", earlier).join(above, parent).withColumn("before", F.col("before") + F.col("_above")).drop("_above")
    return out


def ranked(work: Work, rows: DataFrame) -> DataFrame:
    """g, total, rank, h, k, leaf, changed: each leaf's place, from 0, among its language's ``total``, by id, then by digest.

    Ids on several rows go on with the digits of the digest, and equal leaves are
    counted, not sorted: they take the places that follow each other.
    """
    cells = work.written(
        rows.withColumn("salt", salt("leaf")).groupBy("g", "h", "k").agg(F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"), F.min("changed").alias("changed"), salt_mask("salt").alias("mask")), "ids"
    )
    ends = cells.agg(F.min("k"), F.max("k"), F.max("n")).first()
    top = 0
    while ends[0] is not None and (ends[1] >> (DIGIT * top)) - (ends[0] >> (DIGIT * top)) >= 1 << DIGIT:
        top += 1
    named = {f"p{j}": F.shiftright("k", DIGIT * j) for j in range(top, 0, -1)}
    found = placed(cells.select("g", "h", "k", "n", *[c.alias(name) for name, c in named.items()]), ["g"], ["h", *named, "k"]).select("g", "h", "k", "before", "total")
    columns = ["g", "total", "rank", "h", "k", "leaf", "changed"]
    out = cells.where("n = 1").join(found, ["g", "h", "k"]).withColumn("rank", F.col("before")).select(*columns)
    if ends[2] is None or ends[2] == 1:
        return out
    several = cells.where("n > 1").select("g", "h", "k", "mask").join(found, ["g", "h", "k"])
    met = meet(rows.withColumn("salt", salt("leaf")), several, ["g", "h", "k"]).withColumn("d1", F.hex(F.substring("leaf", 1, 1))).withColumn("d2", F.hex(F.substring("leaf", 1, 3)))
    ties = work.written(met.groupBy("g", "h", "k", "total", F.col("before").alias("first"), "d1", "d2", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("changed").alias("changed")), "ties")
    inside = placed(ties.select("g", "h", "k", "d1", "d2", "leaf", "n"), ["g", "h", "k"], ["d1", "d2", "leaf"]).select("g", "h", "k", "leaf", "before")
    again = ties.join(inside, ["g", "h", "k", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}")))).repartition("g", "h", "k", "leaf", "block")
    again = again.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)))
    return out.unionByName(again.withColumn("rank", F.col("first") + F.col("before") + F.col("copy")).select(*columns))


def reduced(work: Work, nodes: DataFrame, most: int, own: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of each pass, from the leaves up, and g, node: one node of each group.

    ``nodes`` have g, total, rank, leaf (bytes) and columns ``own`` to be kept;
    ``most`` is the greatest total. A chunk holds at most CHUNK nodes that share
    their rank's longer prefix, and the levels above them up to one node.
    """
    passes = []
    while True:
        kids = F.sort_array(F.collect_list(F.struct("rank", "leaf", *own))).alias("kids")
        chunk = nodes.groupBy("g", "total", F.expr(f"rank div {CHUNK}").alias("chunk")).agg(kids)
        chunk = chunk.withColumn("l0", F.transform("kids", lambda x: F.lower(F.hex(x["leaf"]))))
        for level in range(DEEP):
            below = F.col(f"l{level}")
            joined = lambda runs, below=below: F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256))
            runs = F.sequence(F.lit(0), F.expr(f"(size(l{level}) - 1) div {FANOUT}").cast("int"))
            chunk = chunk.withColumn(f"l{level + 1}", F.when(F.col("total") > FANOUT**level, joined(runs)).otherwise(below))
        chunk = work.written(chunk.withColumn("node", F.col(f"l{DEEP}")[0]).drop(f"l{DEEP}"), "trie")
        passes.append(chunk)
        most, own = -(-most // CHUNK), []
        if most <= 1:
            return passes, chunk.select("g", "node")
        nodes = chunk.select("g", F.expr(f"(total + {CHUNK - 1}) div {CHUNK}").alias("total"), F.col("chunk").alias("rank"), F.unhex("node").alias("leaf"))


def places() -> Column:
    return F.sequence(F.lit(0), F.size("kids") - 1)


def path(place: Column) -> Column:
    """The levels between a chunk's node and the kid at ``place``: what stands before and after its ancestor in each run."""
    steps = []
    for level in range(DEEP):
        row, at = F.col(f"l{level}"), F.shiftright(place, 3 * level)
        begins = at - F.pmod(at, F.lit(FANOUT))
        before, after = F.array_join(F.slice(row, begins + 1, at - begins), ""), F.array_join(F.slice(row, at + 2, begins + FANOUT - 1 - at), "")
        steps.append(F.when(F.col("total") > FANOUT**level, F.struct(before.alias("before"), after.alias("after"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def downwards(passes: list[DataFrame], ups: DataFrame, also: list[str]) -> DataFrame:
    """The lowest chunks with ``path``, the levels above their node, and ``also``, from these columns (and g, chunk) of the highest ones."""
    for chunks in reversed(passes[1:]):
        each = lambda p: F.struct(F.col("kids")[p]["rank"].alias("chunk"), F.concat(path(p), F.col("path")).alias("path"))
        below = chunks.join(ups, ["g", "chunk"]).select("g", *also, F.explode(F.transform(places(), each)).alias("d"))
        ups = below.select("g", *also, "d.chunk", "d.path")
    return passes[0].join(ups, ["g", "chunk"])


def ordered(work: Work, subroots: DataFrame) -> tuple[DataFrame, int]:
    """name, total, rank, leaf of each language, and their number; parts follow each other by range, a number each goes to the driver."""
    n = subroots.count()
    dealt = subroots.repartitionByRange(max(1, -(-n // PART)), "g").select(F.col("g").alias("name"), F.unhex("node").alias("leaf"), F.spark_partition_id().alias("part"))
    dealt = work.written(dealt, "languages")
    sizes, starts, at = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}, {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("part")] if starts else F.lit(0)
    rank = start + F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return dealt.select(F.lit("").alias("g"), F.lit(n).cast("long").alias("total"), rank.cast("long").alias("rank"), "leaf", "name"), n


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and lang, rank, tampered.

    1. Each row's digest, and that of its tampered form, are written: texts are read once.
    2. Ids are counted by prefixes of their digits; a row's rank in its language
       is the sum of the counts before it, level by level (:func:`placed`).
    3. Nodes of CHUNK ranks with a common prefix are reduced together; the nodes
       of the chunks are the next pass's leaves. Subroots are reduced likewise.
    4. Paths come down the same chunks: a row's proof is the digest of all its
       siblings, and its root is folded from its (tampered) leaf along them.

    A null id precedes all others of its language; rows of one id are ordered by
    their digest, equal rows take places that follow each other, so repeated rows
    all count. Null fields are ``-``, empty texts ``0:``. Long texts are hashed
    whole. An empty table gives no rows. Columns other than doc_id, source, lang,
    n_chars and text are ignored, whatever their names.
    """
    with Work() as work:
        rows = work.written(leaves(docs), "leaves")
        nodes = work.written(ranked(work, rows), "ranks")
        most = nodes.agg(F.max("total")).first()[0] or 0
        passes, subroots = reduced(work, nodes, most, ["h", "k", "changed"])
        langs, n = ordered(work, subroots)
        above, roots = reduced(work, langs, n, ["name"])
        top = roots.select("g", F.lit(0).cast("long").alias("chunk"), F.array().cast(PATH).alias("path"), F.col("node").alias("root"))

        def language(p: Column) -> Column:
            kid = F.col("kids")[p]
            return F.struct(kid["name"].alias("g"), F.lower(F.hex(kid["leaf"])).alias("subroot"), F.concat(path(p), F.col("path")).alias("path"))

        down = downwards(above, top, ["root"]).select("root", F.explode(F.transform(places(), language)).alias("d"))
        # a language has one chunk in the highest pass, so no key is hot
        down = work.written(down.select("d.g", F.lit(0).cast("long").alias("chunk"), "d.path", "d.subroot", "root"), "subroots")

        def row(p: Column) -> Column:
            kid, steps = F.col("kids")[p], F.concat(path(p), F.col("path"))
            leaf = F.lower(F.hex(kid["leaf"]))
            proof = F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
            folded = F.aggregate(steps, F.coalesce(F.lower(F.hex(kid["changed"])), leaf), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
            return F.struct(F.when(kid["h"] == 1, kid["k"]).alias("doc_id"), kid["rank"].alias("rank"), leaf.alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"), kid["changed"].isNotNull().alias("tampered"))

        out = downwards(passes, down, ["subroot", "root"]).select("g", "subroot", "root", F.explode(F.transform(places(), row)).alias("r"))
        lang = F.when(F.substring("g", 1, 1) == "1", F.expr("substring(g, 2)")).alias("lang")
        return written(out.select("r.doc_id", "r.leaf", "subroot", "root", "r.proof_sha256", "r.folded_root", (F.col("r.folded_root") == F.col("root")).alias("verified"), lang, "r.rank", "r.tampered"), "manifest")
