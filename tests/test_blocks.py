"""Files read in ranges give what they hold, however they are cut; headers that are wrong are told."""

from __future__ import annotations

import numpy as np
import pytest

from stateflux.sources import blocks
from tests.test_operators import edf


def brainvision(folder, name: str, x: np.ndarray, number: str = "INT_16", orientation: str = "MULTIPLEXED", scale: float = 0.1) -> str:
    kind = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}[number]
    stored = (x / scale).round().astype(kind) if kind == "<i2" else (x / scale).astype(kind)
    (folder / f"{name}.eeg").write_bytes((stored.T if orientation == "MULTIPLEXED" else stored).tobytes())
    infos = "\n".join(f"Ch{i + 1}=C\\1{i},,{scale},uV" for i in range(len(x)))
    (folder / f"{name}.vhdr").write_text(
        f"Brain Vision Data Exchange Header File Version 1.0\n; made for a test\n[Common Infos]\nDataFile=$b.eeg\nMarkerFile={name}.vmrk\nDataFormat=BINARY\nDataOrientation={orientation}\nNumberOfChannels={len(x)}\nSamplingInterval=2000\n"
        f"[Binary Infos]\nBinaryFormat={number}\n[Channel Infos]\n{infos}\n[Coordinates]\nCh1=1,90,0\nCh2=1,0,0\n[Comment]\nfree = text, [odd\nlines\n"
    )
    (folder / f"{name}.vmrk").write_text("Brain Vision Data Exchange Marker File, Version 1.0\n[Common Infos]\nDataFile=x\n[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,11,2,0\n")
    return f"file://{folder}/{name}.vhdr"


def table(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize("size", [1, 500, 1 << 24])
def test_ranges_give_the_whole_file(spark, tmp_path, size):
    rng = np.random.default_rng(4)
    x = rng.uniform(-90, 90, (3, 400))
    (tmp_path / "a.edf").write_bytes(edf(x, 20))
    (tmp_path / "b.BDF").write_bytes(edf(x, 20, 24) + b"cut")
    paths = [f"file://{tmp_path}/a.edf", f"{tmp_path}/b.BDF", brainvision(tmp_path, "c", x), brainvision(tmp_path, "d", x, "IEEE_FLOAT_32", "VECTORIZED")]
    files = table(spark, [*paths, *paths, None]).selectExpr("*", "1 as pos")
    samples, channels = blocks.read_blocks(files, size=size)
    got: dict = {}
    for r in samples.orderBy("path", "pos").collect():
        got.setdefault(r["path"], []).append((r["pos"], r["v"]))
    assert set(got) == set(paths)
    for p, error in zip(paths, (0.005, 1e-4, 0.0501, 1e-4)):
        assert [i for i, _ in got[p]] == list(range(400))
        assert np.abs(np.array([v for _, v in got[p]]).T - x).max() < error, p
    told = {(r["path"], r["idx"]): r for r in channels.collect()}
    assert len(told) == 12 and told[paths[0], 1]["label"] == "EEG Cz" and told[paths[0], 0]["rate"] == 20
    assert told[paths[2], 2]["label"] == "C,2" and told[paths[3], 0]["rate"] == 500
    assert told[paths[2], 0]["x"] == pytest.approx(1) and told[paths[2], 1]["z"] == pytest.approx(1) and told[paths[2], 2]["x"] is None
    if size == 1:
        assert blocks.plan(files, size=1).count() == 20 + 20 + 400 + 400


def test_channels_are_pruned_and_ordered(spark, tmp_path):
    x = np.arange(60.0).reshape(3, 20)
    (tmp_path / "a.edf").write_bytes(edf(x, 20))
    files = table(spark, [f"file://{tmp_path}/a.edf", brainvision(tmp_path, "c", x, "IEEE_FLOAT_32", "VECTORIZED", 1.0)])
    rows = blocks.read_blocks(files, ["c,2", "EEG CZ", "C,0"])[0].where("pos = 7").collect()
    got = {r["path"][-4:]: np.array(r["v"], float) for r in rows}
    assert np.allclose(got[".edf"], [np.nan, 27, np.nan], atol=0.005, equal_nan=True) and np.allclose(got["vhdr"], [47, np.nan, 7], equal_nan=True)


def test_rates_that_differ_and_records_that_were_not_counted(spark, tmp_path):
    data = bytearray(edf(np.arange(80.0).reshape(2, 40), 20))
    data[236:244] = b"-1      "
    n = 2
    sizes = 256 + n * 216
    data[sizes + 8 : sizes + 16] = b"10      "
    head, body = bytes(data[: 256 * 3]), np.frombuffer(bytes(data[256 * 3 :]), "<i2").reshape(2, 2, 20)
    (tmp_path / "a.edf").write_bytes(head + b"".join(r[0].tobytes() + r[1][::2].tobytes() for r in body))
    got = np.array([r["v"] for r in blocks.read_blocks(table(spark, [f"{tmp_path}/a.edf"]), size=1)[0].orderBy("pos").collect()]).T
    assert np.abs(got[0] - np.arange(40)).max() < 0.005 and np.abs(got[1] - (40 + np.arange(40) // 2 * 2)).max() < 0.005


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.edf").write_bytes(b"short")
    (tmp_path / "b.vhdr").write_text("no header")
    (tmp_path / "c.vhdr").write_text("x\n[Common Infos]\nDataFile=none.eeg\nNumberOfChannels=0\nSamplingInterval=0\n[Channel Infos]\n")
    names = ["a.edf", "b.vhdr", "c.vhdr", "d.bdf", "e.txt"]
    samples, channels = blocks.read_blocks(table(spark, [f"{tmp_path}/{n}" for n in names]))
    assert samples.count() == 0
    rows = channels.collect()
    assert len(rows) == len(names) and all(r["error"] and r["idx"] is None for r in rows)
    empty = blocks.read_blocks(table(spark, []))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_markers(spark, tmp_path):
    path = brainvision(tmp_path, "c", np.zeros((2, 30)))
    got = [tuple(r)[1:] for r in blocks.read_markers(table(spark, [path, path, f"{tmp_path}/none.vhdr", "a.edf"])).orderBy("pos").collect()]
    assert got == [("New Segment", "", 0, 1), ("Stimulus", "S  1", 10, 2)]
