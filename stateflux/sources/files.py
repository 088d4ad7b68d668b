"""Files as tables: recordings' paths, manifests, sequences, behaviour tables, state maps, configurations, templates."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stateflux.functions import text as X
from stateflux.operators.tables import first_match, first_row

#: Endings of recordings, words in paths that are none, and the names a manifest's columns go by.
ENDINGS = ["set", "fif", "edf", "bdf", "gdf", "cnt", "vhdr", "mff", "mat", "fif.gz"]
NO_RECORDING = r"(?i)(behaviou?r|localizer|localiser)"
MANIFEST = {
    "participant": ["participant", "participant_id", "subject", "subject_id", "id"], "condition": ["condition", "task", "state"], "group": ["group", "cohort", "diagnosis"],
    "file_path": ["file_path", "filepath", "path", "file", "filename", "set_file"],
}


def recordings(spark: SparkSession, folder: str, endings: Sequence[str] = ENDINGS) -> DataFrame:
    """path, name, ending, size of every recording below a folder; of folders, those called eeg count alone if there are any.

    Only names are read, in one distributed listing.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    pattern = r"(?i)\.(" + "|".join(re.escape(e) for e in endings) + ")$"
    rows = rows.where(F.col("path").rlike(pattern) & ~F.col("path").rlike(NO_RECORDING)).select("path", X.file_name(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", pattern, 1)).alias("ending"), "size")
    eeg = F.col("path").rlike(r"(?i)/[^/]*eeg[^/]*/")
    some = rows.agg(F.coalesce(F.max(eeg), F.lit(False)).alias("_eeg"))
    return rows.crossJoin(F.broadcast(some)).where(~F.col("_eeg") | eeg).drop("_eeg").distinct()  # one row


def manifest_of(files: DataFrame, path: str = "path") -> DataFrame:
    """participant, condition, file_path of recordings, by their names, in the order of paths."""
    stem = X.file_stem(F.col(path))
    sub = F.nullif(F.regexp_extract(X.file_name(F.col(path)), r"(?i)(sub-\d+)", 1), F.lit(""))
    plain = F.replace(F.lower(stem), F.lit("-"), F.lit("_"))
    closed, opened = plain.rlike("_ec|closed"), plain.rlike("_eo|open")
    condition = F.when(closed, "eyes_closed").when(opened, "eyes_open").otherwise("unknown")
    return files.select(F.coalesce(sub, F.split(stem, "_")[0]).alias("participant"), condition.alias("condition"), F.col(path).alias("file_path")).orderBy("file_path")


def read_manifest(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """participant, condition, group, file_path of a CSV or TSV file under any of the columns' names.

    Blanks are inferred from the path (participant, condition) or ``all`` (group);
    relative paths begin at ``base``, else at the file's folder. Rows without a path go.
    """
    rows = spark.read.csv(path, header=True, sep="\t" if path.lower().endswith((".tsv", ".txt")) else ",")
    rows = X.aliased(rows, MANIFEST)
    folder = (base or path.rpartition("/")[0]).rstrip("/")
    file = F.trim(F.col("file_path").cast("string"))
    absolute = file.rlike(r"^(/|[A-Za-z]:[\\/]|[a-z0-9]+:/)")
    rows = rows.where(F.coalesce(file, F.lit("")) != "").withColumn("file_path", F.when(absolute, file).otherwise(F.concat(F.lit(folder + "/"), file)))
    place = F.row_number().over(Window.orderBy("file_path"))  # a manifest has a row a recording
    given = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.withColumn("_place", place).select(
        F.coalesce(given("participant"), X.participant(F.col("file_path"), F.col("_place"))).alias("participant"), F.coalesce(given("condition"), X.eyes_from_path(F.col("file_path"))).alias("condition"),
        F.coalesce(given("group"), F.lit("all")).alias("group"), "file_path",
    ).orderBy("file_path")


def preferred_manifest(candidates: Sequence[DataFrame], inferred: DataFrame) -> DataFrame:
    """The rows of the first of several manifests that has any, else those inferred from sequences; for each participant and condition the first by path."""
    out, found = inferred, False
    for table in candidates:
        if not table.isEmpty():
            out, found = table, True
            break
    named = X.aliased(out, {**MANIFEST, "study": ["study"]}) if found else out
    group = X.group(F.col("group").cast("string"), F.col("participant").cast("string"))
    rows = named.withColumn("condition", F.col("condition").cast("string")).withColumn("group", group).withColumn("study", F.coalesce(F.nullif(F.trim(F.col("study").cast("string")), F.lit("")), X.study(group)) if "study" in named.columns else X.study(group))
    return first_row(rows, ["participant", "condition"], F.col("file_path"))


def state_of(df: DataFrame) -> Column:
    """A sequence's states by the first of the columns that name them."""
    have = set(df.columns)
    if "microstate_name" in have:
        return X.state_name(F.col("microstate_name"))
    if "template_label" in have:
        return X.state_name(F.col("template_label"))
    if "microstate_label" in have:
        return X.state_name(F.col("microstate_label").cast("string"))
    if "state_index_1based" in have:
        return F.char(F.col("state_index_1based").cast("int") + 64)
    raise ValueError("a sequence names its states in microstate_name, template_label, microstate_label or state_index_1based")


def read_sequences(spark: SparkSession, paths: str | Sequence[str], manifest: DataFrame | None = None) -> DataFrame:
    """participant, condition, group, study, sample_index, state, gfp, sequence_csv of sequence files.

    Participant and condition come from the columns, else from the file's name
    (sub-X_task). Of several files of one participant and condition, one with
    global_sequence in its name counts, then the first by path. Group and study
    come from the manifest's first row, else from the participant's number.
    """
    raw = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True).withColumn("sequence_csv", F.input_file_name())
    have = set(raw.columns)
    col = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    name = X.file_name(F.col("sequence_csv"))
    sid = F.coalesce(F.nullif(F.trim(col("participant")), F.lit("")), F.nullif(F.regexp_extract(name, r"((?:sub|suj)[-_][A-Za-z0-9]+)", 1), F.lit("")), X.file_stem(F.col("sequence_csv")))
    task = X.task_from_path(F.coalesce(F.nullif(F.trim(col("condition")), F.lit("")), name))
    rows = raw.select(sid.alias("participant"), task.alias("condition"), col("sample_index", "long").alias("sample_index"), state_of(raw).alias("state"), col("gfp").try_cast("double").alias("gfp"), "sequence_csv")
    files = rows.select("participant", "condition", "sequence_csv").distinct()
    one = first_row(files, ["participant", "condition"], F.lower("sequence_csv").contains("global_sequence").desc(), F.col("sequence_csv"))
    rows = rows.join(one, ["participant", "condition", "sequence_csv"], "left_semi")
    inferred = X.group_of_number(F.col("participant"))
    if manifest is None:
        return rows.withColumn("group", inferred).withColumn("study", X.study(inferred))
    known = manifest.select("participant", "condition", X.group(F.col("group").cast("string"), F.col("participant").cast("string")).alias("group"), "file_path").withColumn("study", X.study(F.col("group")))
    return first_match(rows, known, ["participant", "condition"], [F.col("file_path")], {"group": inferred, "study": X.study(inferred)}).drop("file_path", "found")


def read_behaviour(spark: SparkSession, paths: str | Sequence[str], participant: str = r"^(sub-|suj_)?[A-Za-z]{0,4}-?\d{2,}$") -> DataFrame:
    """participant, name, text: behaviour tables in long form.

    The participants' column is the one most of whose values look like ids, or that
    is called like one; rows that repeat the header (80 % of the cells) go.
    """
    rows = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True)
    columns = rows.columns
    same = sum((F.lower(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) == c.strip().lower()).cast("int") for c in columns)
    rows = rows.where(same < 0.8 * len(columns))
    looks = rows.agg(*[F.avg(F.coalesce(F.trim(F.col(f"`{c}`")).rlike(participant), F.lit(False)).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    named = [1.0 if X.header(c) in ("id", "participant", "participantid", "subject", "subjectid", "initialid", "indiid") else 0.0 for c in columns]
    best = max(range(len(columns)), key=lambda i: (named[i] + (looks[f"s{i}"] or 0.0), -i))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(f"`{c}`")).alias("text")) for i, c in enumerate(columns) if i != best]))
    return rows.select(F.trim(F.col(f"`{columns[best]}`")).alias("participant"), cells.alias("c")).where("participant <> ''").select("participant", "c.name", "c.text").where("text <> ''")


def state_maps(rows: DataFrame, column: str, field: str = "estimated_microstates", key: str = "id") -> DataFrame:
    """key, state, map: the maps in JSON texts, where they are an object of arrays or of objects with a ``map``, or a list of arrays."""
    text = F.get_json_object(F.col(column), f"$.{field}")
    plain = F.from_json(text, "map<string,array<double>>")
    nested = F.from_json(text, "map<string,struct<map:array<double>>>")
    listed = F.from_json(text, "array<array<double>>")
    pair = lambda k, v: F.struct(k.alias("state"), v.alias("map"))
    entries = F.concat(
        F.coalesce(F.transform(F.map_entries(plain), lambda e: pair(e["key"], e["value"])), F.array()),
        F.coalesce(F.transform(F.map_entries(nested), lambda e: pair(e["key"], e["value"]["map"])), F.array()),
        F.coalesce(F.transform(listed, lambda v, i: pair(F.format_string("state_%02d", i + 1), v)), F.array()),
    )
    return rows.select(F.col(key), F.explode(entries).alias("e")).select(key, "e.state", "e.map").where("map is not null and size(map) > 0").distinct()


def templates(maps: DataFrame, labels: Sequence[str] = "ABCDEFG", k: int = 7, number: str = "k", state: str = "state", map_: str = "map") -> DataFrame:
    """label, map: the k canonical maps of a table of solutions, named in order; of more states than labels, the others by number."""
    names = F.array(*[F.lit(x) for x in labels])
    place = F.row_number().over(Window.orderBy(state))  # a solution has some ten states
    rows = (maps.where(F.col(number) == k) if number in maps.columns else maps).withColumn("_place", place)
    return rows.where(F.col("_place") <= k).select(F.coalesce(F.get(names, F.col("_place") - 1), F.concat(F.lit("X"), F.col("_place").cast("string"))).alias("label"), F.col(map_).alias("map"))


def configuration(path: str | None, defaults: Mapping, environ: Mapping[str, str] | None = None) -> dict:
    """A JSON configuration laid over the defaults, object by object; ~ and $NAME in its texts are replaced, unknown names stay."""
    values = json.loads(open(path, encoding="utf-8").read()) if path else {}
    env = os.environ if environ is None else environ

    def expanded(v):
        if isinstance(v, str):
            home = env.get("HOME", "~")
            v = home + v[1:] if v == "~" or v.startswith("~/") else v
            return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2], m[0]), v)
        return {k: expanded(x) for k, x in v.items()} if isinstance(v, dict) else [expanded(x) for x in v] if isinstance(v, list) else v

    def merged(a: Mapping, b: Mapping) -> dict:
        return {**a, **{k: merged(a[k], v) if isinstance(v, Mapping) and isinstance(a.get(k), Mapping) else v for k, v in b.items()}}

    return expanded(merged(copy.deepcopy(dict(defaults)), values))
