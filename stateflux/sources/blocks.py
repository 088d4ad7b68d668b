"""Recordings whose files can be split: EDF, BDF and BrainVision (.vhdr with its data and marker files).

A header is read once, by a task, which plans the file's samples as ranges of
bytes; ranges are dealt to tasks, and each reads its own alone, of its channels
alone. A long file is many partitions, and no file, path or header reaches the
driver.
"""

from __future__ import annotations

import configparser
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a range, about.
RANGE = 16 << 20
#: Numbers in BrainVision files by their names there.
BINARY = {"INT_16": "<i2", "UINT_16": "<u2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4", "IEEE_FLOAT_64": "<f8"}
#: Endings of the files that can be split.
ENDINGS = ("edf", "bdf", "vhdr")

SAMPLES = "path string, pos long, v array<double>"
CHANNELS = "path string, idx int, label string, x double, y double, z double, rate double, error string"


def opened(path: str):
    """A file at a path or address (file:, hdfs:, s3:, gs:) as a stream with positions."""
    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def whole(path: str) -> bytes:
    with opened(path) as file:
        return file.read()


def edf_header(path: str, width: int) -> dict:
    """kind, rate, labels, and where each signal is in a record of an EDF (16 bits) or BDF (24 bits) file; annotations are left out."""
    with opened(path) as file:
        size = file.size()
        first = file.read(256)
        n = int(first[252:256])
        if n < 1:
            raise ValueError("no signals")
        rest = file.read(256 * n)
    if len(rest) < 256 * n:
        raise ValueError("the header ends early")
    column = lambda offset, wide: [rest[n * offset + i * wide : n * offset + (i + 1) * wide].decode("latin-1").strip() for i in range(n)]
    labels = column(0, 16)
    low, high, d_low, d_high = ([float(v) for v in column(o, 8)] for o in (104, 112, 120, 128))
    sizes = [int(v) for v in column(216, 8)]
    at = [0, *np.cumsum(sizes).tolist()]
    used = [i for i in range(n) if "annotations" not in labels[i].lower()]
    if not used or max(sizes[i] for i in used) < 1:
        raise ValueError("no samples")
    top, length = max(sizes[i] for i in used), at[-1] * width
    there = (size - 256 * (n + 1)) // length
    said = int(first[236:244])
    records = there if said < 0 else min(said, there)
    scale = [(high[i] - low[i]) / (d_high[i] - d_low[i]) for i in used]
    return {
        "kind": "edf", "width": width, "head": 256 * (n + 1), "length": length, "records": records, "per_record": top, "rate": top / float(first[244:252]),
        "labels": [labels[i] for i in used], "at": [at[i] for i in used], "sizes": [sizes[i] for i in used], "scale": scale, "shift": [low[i] - d_low[i] * s for i, s in zip(used, scale)],
    }


def sections(path: str) -> configparser.ConfigParser:
    """A BrainVision header or marker file: its title goes, and so does the free text at its end."""
    data = whole(path)
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    lines = text.lstrip("\ufeff").splitlines()[1:]
    comment = next((i for i, line in enumerate(lines) if line.strip().lower() == "[comment]"), len(lines))
    parsed = configparser.ConfigParser(delimiters=("=",), comment_prefixes=(";",), interpolation=None, strict=False)
    try:
        parsed.read_string("\n".join(line for line in lines[:comment] if line.startswith("[") or "=" in line))
    except configparser.Error as error:
        raise ValueError(str(error)) from error
    return parsed


def beside(path: str, name: str) -> str:
    """The file of a name, which may stand for the header's own ($b), in a header's folder."""
    stem = path.rpartition("/")[2].rpartition(".")[0]
    return path[: path.rfind("/") + 1] + name.strip().replace("$b", stem)


def brainvision_header(path: str) -> dict:
    """kind, rate, labels, scales, and the layout of the data file."""
    parsed = sections(path)
    common, binary = parsed["Common Infos"], parsed["Binary Infos"] if parsed.has_section("Binary Infos") else {}
    if common.get("DataFormat", "BINARY").strip().upper() != "BINARY":
        raise ValueError("only binary data files are read")
    number = binary.get("BinaryFormat", "INT_16").strip().upper()
    if number not in BINARY:
        raise ValueError(f"unknown numbers {number}")
    n = int(common["NumberOfChannels"])
    told = [[f.replace("\\1", ",") for f in parsed["Channel Infos"][f"Ch{i + 1}"].split(",")] + [""] * 3 for i in range(n)]
    data, width = beside(path, common["DataFile"]), np.dtype(BINARY[number]).itemsize
    with opened(data) as file:
        samples = file.size() // (n * width)
    places = [[float("nan")] * 3] * n
    if parsed.has_section("Coordinates"):
        for i in range(n):
            radius, theta, phi = ([float(c) for c in parsed["Coordinates"].get(f"Ch{i + 1}", "0,0,0").split(",")] + [0.0] * 3)[:3]
            if radius > 0:  # angles in degrees, theta from the vertex
                a, b = math.radians(theta), math.radians(phi)
                places = [*places[:i], [math.sin(a) * math.cos(b), math.sin(a) * math.sin(b), math.cos(a)], *places[i + 1 :]]
    return {
        "kind": "brainvision", "data": data, "number": BINARY[number], "by_channel": common.get("DataOrientation", "MULTIPLEXED").strip().upper() == "VECTORIZED", "n": n,
        "length": n * width, "records": samples, "per_record": 1, "rate": 1e6 / float(common["SamplingInterval"]),
        "labels": [t[0].strip() for t in told], "scale": [float(t[2] or 1) for t in told], "places": places,
    }


def header(path: str) -> dict:
    ending = path.rpartition(".")[2].lower()
    if ending not in ENDINGS:
        raise ValueError(f"no decoder for .{ending}")
    return brainvision_header(path) if ending == "vhdr" else edf_header(path, 2 if ending == "edf" else 3)


#: What a file that is not what it should be raises.
FAULTS = (ValueError, KeyError, IndexError, OSError, ZeroDivisionError)


def plan(files: DataFrame, path: str = "path", size: int = RANGE) -> DataFrame:
    """path, at, n, head, error: the ranges (first record, number of records) of every file, with its header as JSON; a file that cannot be read has one row with the reason."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                try:
                    head = header(p)
                except FAULTS as error:
                    yield pd.DataFrame({"path": [p], "at": None, "n": None, "head": None, "error": str(error) or type(error).__name__})
                    continue
                step = max(1, size // head["length"])
                # at least one row, so a recording without samples still has channels
                at = np.arange(0, max(head["records"], 1), step)
                for part in range(0, len(at), 4096):
                    some = at[part : part + 4096]
                    yield pd.DataFrame({"path": p, "at": some, "n": np.minimum(step, head["records"] - some), "head": json.dumps(head), "error": None})

    return files.select(F.col(path).alias("path")).where("path is not null").distinct().mapInPandas(ranges, "path string, at long, n long, head string, error string")


def edf_values(path: str, head: dict, at: int, n: int, used: list[int]) -> np.ndarray:
    """used channels by samples of n records; signals with a lower rate than the fastest are repeated."""
    with opened(path) as file:
        raw = np.frombuffer(file.read_at(n * head["length"], head["head"] + at * head["length"]), np.uint8).reshape(n, -1, head["width"])
    out, top = np.empty((len(used), n * head["per_record"])), head["per_record"]
    for row, i in enumerate(used):
        part = raw[:, head["at"][i] : head["at"][i] + head["sizes"][i]]
        if head["width"] == 2:
            value = np.ascontiguousarray(part).view("<i2")[:, :, 0].astype(float)
        else:
            value = (part[:, :, 0].astype(np.int32) | part[:, :, 1].astype(np.int32) << 8 | part[:, :, 2].astype(np.int8).astype(np.int32) << 16).astype(float)
        out[row] = (value * head["scale"][i] + head["shift"][i])[:, np.arange(top) * head["sizes"][i] // top].ravel()
    return out


def brainvision_values(head: dict, at: int, n: int, used: list[int]) -> np.ndarray:
    width = np.dtype(head["number"]).itemsize
    with opened(head["data"]) as file:
        if head["by_channel"]:
            rows = [np.frombuffer(file.read_at(n * width, (i * head["records"] + at) * width), head["number"]) for i in used]
        else:
            rows = list(np.frombuffer(file.read_at(n * head["length"], at * head["length"]), head["number"]).reshape(n, -1).T[used])
    return np.array([row * head["scale"][i] for row, i in zip(rows, used)], float).reshape(len(used), n)


def samples_of(planned: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """path, pos, v of planned ranges, with the channels asked for, in that order; null for one that a file has not, and for a stored NaN."""
    wanted = None if channels is None else [c.lower() for c in channels]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, at, n, told in zip(pdf["path"], pdf["at"], pdf["n"], pdf["head"]):
                head = json.loads(told)
                names = [c.lower() for c in head["labels"]]
                places = list(range(len(names))) if wanted is None else [names.index(c) if c in names else -1 for c in wanted]
                used = [i for i in places if i >= 0]
                x = edf_values(p, head, int(at), int(n), used) if head["kind"] == "edf" else brainvision_values(head, int(at), int(n), used)
                v = np.full((x.shape[1], len(places)), np.nan)
                v[:, [k for k, i in enumerate(places) if i >= 0]] = x.T
                first = int(at) * head["per_record"]
                for part in range(0, len(v), 1 << 14):
                    some = v[part : part + (1 << 14)]
                    yield pd.DataFrame({"path": p, "pos": np.arange(first + part, first + part + len(some)), "v": list(some)})

    ranges = planned.where("n > 0").select("path", "at", "n", "head")
    # by a hash of the range, so that one file's ranges are on many tasks
    return ranges.repartition(F.xxhash64("path", "at")).mapInPandas(work, SAMPLES)


def channels_of(planned: DataFrame) -> DataFrame:
    """path, idx, label, x, y, z, rate, error of the channels of planned files, by their first range; places are null where a file has none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, told, error in zip(pdf["path"], pdf["head"], pdf["error"]):
                if told is None:
                    yield pd.DataFrame([{"path": p, "idx": None, "label": None, "x": None, "y": None, "z": None, "rate": None, "error": error}])
                    continue
                head = json.loads(told)
                xyz = head.get("places") or [[float("nan")] * 3] * len(head["labels"])
                yield pd.DataFrame({"path": p, "idx": range(len(head["labels"])), "label": head["labels"], **{c: [None if q[i] != q[i] else q[i] for q in xyz] for i, c in enumerate("xyz")}, "rate": head["rate"], "error": None})

    return planned.where("at = 0 or error is not null").mapInPandas(work, CHANNELS)


def read_blocks(files: DataFrame, channels: Sequence[str] | None = None, path: str = "path", size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Samples (path, pos, v) and channels (path, idx, label, x, y, z, rate, error) of EDF, BDF and BrainVision files in a table of paths.

    ``channels`` names those whose values are read, whatever their case. A file
    of another kind, or one that cannot be read, has one row of channels with
    the reason and no samples. A path on several rows is read once, null ones
    are left out. The last record of a file that ends within it is left out.
    """
    planned = plan(files, path, size)
    return samples_of(planned, channels), channels_of(planned)


def read_markers(files: DataFrame, path: str = "path") -> DataFrame:
    """path, kind, description, pos, n of the markers of BrainVision recordings: positions from 0, ``n`` samples long. Files without readable markers have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                try:
                    marks = sections(beside(p, sections(p)["Common Infos"]["MarkerFile"]))["Marker Infos"]
                    rows = [[f.replace("\\1", ",") for f in told.split(",")] for told in marks.values()]
                    yield pd.DataFrame([{"path": p, "kind": r[0], "description": r[1], "pos": int(r[2]) - 1, "n": int(r[3]) if r[3:] and r[3] else 0} for r in rows], columns=["path", "kind", "description", "pos", "n"])
                except FAULTS:
                    continue

    return files.select(F.col(path).alias("path")).where("lower(path) like '%.vhdr'").distinct().mapInPandas(work, "path string, kind string, description string, pos long, n long")
