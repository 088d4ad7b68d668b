"""Parsing of identifiers, labels and numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def participant(path: Column, row: Column) -> Column:
    """The sub-... part of a path, else the folder above the file, else a number for the row."""
    sub = F.nullif(F.regexp_extract(path, r"(sub-[A-Za-z0-9]+)", 1), F.lit(""))
    parent = F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit(""))
    return F.coalesce(sub, parent, F.format_string("row%03d", row))


def eyes_from_path(path: Column, other: str = "condition") -> Column:
    """EC or EO by the file's stem, else ``other``; closed eyes are looked for first."""
    stem = F.upper(file_stem(path))
    has = lambda *xs: [stem.contains(x) for x in xs]
    closed, opened = has("_EC", "EYESCLOSED", "CLOSED"), has("_EO", "EYESOPEN", "OPEN")
    return F.when(closed[0] | closed[1] | closed[2], "EC").when(opened[0] | opened[1] | opened[2], "EO").otherwise(other)


def task_from_path(path: Column) -> Column:
    """intero_fb, feedback, extero, intero, full or unknown, by the file's name."""
    name = F.lower(file_name(path))
    both = name.contains("intero_fb") | name.contains("intero-fb") | name.contains("interofb")
    full = name.contains("full") | name.rlike(r"^suj_\d+_pp_raw\.fif$")
    return F.when(both, "intero_fb").when(name.contains("feedback") | name.contains("hbt_c"), "feedback").when(name.contains("extero"), "extero").when(name.contains("intero"), "intero").when(full, "full").otherwise("unknown")


def condition(text: Column) -> Column:
    """The normal form EC or EO of a condition's name, else the name without blanks around; a null is empty."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    key = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(key.isin("ec", "eyes_closed", "eye_closed", "closed"), "EC").when(key.isin("eo", "eyes_open", "eye_open", "open"), "EO").otherwise(plain)


def identifier(text: Column) -> Column:
    """Letters, digits and underscores; the rest becomes one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def slug(text: Column) -> Column:
    """An identifier in lower case; ``unnamed`` if nothing is left."""
    return F.coalesce(F.nullif(identifier(F.lower(F.trim(text))), F.lit("")), F.lit("unnamed"))


def channel(text: Column) -> Column:
    """A channel label in lower case: no blanks, no prefixes eeg, channel and chan in turn, no signs; a number without leading zeros."""
    plain = F.regexp_replace(F.lower(text), r"\s+", "")
    for prefix in ("eeg", "channel", "chan"):
        plain = F.regexp_replace(plain, f"^{prefix}", "")
    plain = F.regexp_replace(plain, r"[^a-z0-9]", "")
    return F.when(plain.rlike(r"^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(plain, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(plain)


def token(text: Column) -> Column:
    """Lower case, underscores and hyphens as blanks, single blanks between words; a null is empty."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"[_-]", " "), r"\s+", " ")


def method(text: Column) -> Column:
    """One name for each method's spellings; others as tokens."""
    t = token(text)
    return (
        F.when(t.contains("spm vb"), "spm vb")
        .when(t.contains("kmeans koenig") | t.contains("koenig kmeans"), "koenig kmeans")
        .when(t.contains("standard kmeans") | t.contains("kmeans standard"), "standard kmeans")
        .otherwise(t)
    )


#: Names of criteria that stand for others.
CRITERIA = {
    "elbow": "free energy elbow", "gfp": "gev", "global field power": "gev", "global explained variance": "gev", "free energy elbow only": "free energy elbow", "silhouette only": "silhouette",
    "covariance raw": "covariance", "covariance min": "covariance", "calinski harabasz": "calinski harabasz score", "ch": "calinski harabasz score",
}


def criterion(text: Column) -> Column:
    """One name for each criterion's spellings; in others a word that is repeated stands once."""
    t = token(text)
    out = F.when(t.contains("elbow sil"), "elbow sil combined")
    for name, stands_for in CRITERIA.items():
        out = out.when(t == name, stands_for)
    return out.otherwise(F.regexp_replace(t, r"(\b\w+\b)(\s+\1)+", "$1"))


#: Spellings of groups, and the ranges of participants' numbers with their group and study.
GROUPS = {
    "ANX": ["ANX", "ANXIETY", "ANXIOUS"], "NANX": ["NANX", "NONANX", "NONANXIOUS", "NONANXIETY", "NONANXIOUSCONTROL"],
    "HTN": ["HTN", "HYPERTENSION", "HYPERTENSIVE"], "NHTN": ["NHTN", "NONHTN", "NONHYPERTENSION", "NONHYPERTENSIVE"],
}
RANGES = [(1, 100, "ANX", "ANX"), (100, 200, "NANX", "ANX"), (700, 800, "HTN", "HTN"), (800, 900, "NHTN", "HTN")]


def group_of_number(sid: Column) -> Column:
    """The group that the first number in an id belongs to, or unknown."""
    n = F.regexp_extract(sid, r"(\d+)", 1).try_cast("long")
    out = F.when(n.isNull(), "unknown")
    for low, high, group, _ in RANGES:
        out = out.when((n >= low) & (n < high), group)
    return out.otherwise("unknown")


def group(name: Column, sid: Column) -> Column:
    """A group's normal name; a blank or unknown one is inferred from the id."""
    plain = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), r"[^A-Z0-9]+", "")
    out = F.when(plain.isin("", "NAN", "NONE", "UNKNOWN") & (F.coalesce(sid, F.lit("")) != ""), group_of_number(sid))
    for normal, spellings in GROUPS.items():
        out = out.when(plain.isin(*spellings), normal)
    return out.otherwise(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown")))


def study(group_name: Column) -> Column:
    return F.when(group_name.isin("ANX", "NANX"), "ANX").when(group_name.isin("HTN", "NHTN"), "HTN").otherwise("unknown")


def state_name(text: Column) -> Column:
    """The bare name of a state: MS_A, state A and A are the same."""
    plain = F.regexp_replace(F.upper(F.trim(text)), r"[^A-Z0-9]+", "")
    plain = F.when(plain.startswith("MS") & (F.length(plain) > 2), F.substring(plain, 3, 1 << 20)).otherwise(plain)
    return F.when(plain.startswith("STATE"), F.replace(plain, F.lit("STATE"), F.lit(""))).otherwise(plain)


def number(text: Column) -> Column:
    """A number, perhaps quoted, after one sign of comparison and with thousands separators; null for anything else, NA and blanks included."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r'^"+|"+$', ""), ",", "")
    plain = F.trim(F.regexp_replace(plain, "^[<>]", ""))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def flag(text: Column) -> Column:
    """Whether a text says yes; a null says no."""
    return F.coalesce(F.lower(F.regexp_replace(F.trim(text), r'^"+|"+$', "")).isin("1", "true", "t", "yes", "y"), F.lit(False))


def age_midpoint(text: Column) -> Column:
    """The middle of a bin such as 20-25, else the number itself."""
    low, high = (F.regexp_extract(text, r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*$", i).try_cast("double") for i in (1, 2))
    return F.coalesce((low + high) / 2, number(text))


def filled(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def finite(x: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0)))


def header(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def aliased(df: DataFrame, wanted: Mapping[str, Sequence[str]], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The wanted columns, each from the first of its aliases that names a column of ``df`` (letters and digits count, case does not); one that has none is its default or null."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(header(c), c)
    out = []
    for name, aliases in wanted.items():
        hit = next((have[header(a)] for a in aliases if header(a) in have), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit((defaults or {}).get(name))).alias(name))
    return df.select(*out)


def by_suffix(names: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """What the first rule (suffix, result) says of a name whose end it has; null if none does."""
    return F.coalesce(*[F.when(names.endswith(suffix), F.lit(result)) for suffix, result in rules])
