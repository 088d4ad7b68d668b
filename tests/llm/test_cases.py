"""Null and repeated ids, clashing columns, whole tables against the libraries, and labelled junk."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from stateflux.llm import bpe, common, near_dedup, packing, pfor, quality, queries, warc

SMALL = "/root/testdata/sf0.01"
ODD_IDS = "doc_id long, text string, ids binary, part int, place string, n long, s string, key int, salt string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, b"", 1, "x", 2, "y", 3, "z") for i, t in rows], ODD_IDS)


ROWS = [(None, "no id"), (None, "no id"), (3, "three"), (3, "another three"), (3, "three"), (1, None), (2, ""), (-4, "long " * 4000)]


def library(name, end, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name)[0])
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_packing_of_null_and_repeated_ids(spark):
    got = packing.pack(odd(spark, ROWS), *queries.vocabulary(queries.BYTE_BPE), end=1, with_ids=True).collect()
    want = library(queries.BYTE_BPE, 1, [t for _, t in ROWS])
    spans = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in got)
    assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) == sum(map(len, want))
    whole = sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got if r["length"] == r["doc_tokens"])
    assert [x for x in whole if x[1] != -4] == sorted((i is not None, i or 0, w.tobytes()) for (i, _), w in zip(ROWS, want) if i != -4)


def test_token_files_of_null_and_repeated_ids(spark):
    want = library(queries.WORD_BPE, 2, [t for _, t in ROWS])
    got = pfor.stored_ids(odd(spark, ROWS), queries.vocabulary(queries.WORD_BPE)[0], None, 2).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, len(w), zlib.crc32(w.tobytes())) for (i, _), w in zip(ROWS, want))
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist() and [r["doc_id"] for r in rows] == [None, None, -4, 1, 2, 3, 3, 3]


def test_one_id_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(pfor, "SPAN", (200, 1 << 30))
    docs = spark.range(200).selectExpr("7L as doc_id", "concat('word ', id) as text")
    files = pfor.write_ids(docs, queries.vocabulary(queries.WORD_BPE)[0], None, 2, common.scratch(spark, "ids"))
    assert len(files) > 1 and sum(f[1] for f in files) == 200
    rows = sorted(pfor.read_back(spark, files).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(17)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, a), (None, c), (None, None), (5, None), (5, None)]
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (-1, 1, False), (-1, None, True), (-1, None, True), (5, 5, True), (5, 5, True)], key=repr)


def test_archives_of_null_and_repeated_ids(spark):
    big = "<p>" * 400
    rows = [(1, "u", big), (1, "v", big), (2, None, big), (2, "w", big), (None, "x", big), (None, "y", None), (3, "z", ""), (3, "z", "")]
    pages = spark.createDataFrame([(*r, 9, "d", 8) for r in rows], "page_id long, url string, html string, size int, digest string, last long")
    got = warc.archived(pages, with_payload=True).collect()
    kinds = sorted(repr((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])) for r in got)
    assert kinds == sorted(map(repr, [(1, "revisit", 2, 1200)] * 2 + [(2, "response", None, 1200)] * 2 + [(None, "revisit", 2, 1200), (None, "response", None, 0)] + [(3, "response", None, 0)] * 2))


@pytest.mark.parametrize("name,end", [(queries.BYTE_BPE, 1), (queries.WORD_BPE, 2)])
def test_ids_of_a_whole_table_are_the_librarys(spark, name, end):
    docs = common.load(spark, SMALL, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: w for i, w in zip(texts, library(name, end, texts.values()))}
    path, pattern = queries.vocabulary(name)
    if name == queries.BYTE_BPE:
        got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.tokenised(docs, path, pattern, end).collect()}
        assert got.keys() == want.keys() and all((got[i] == want[i]).all() for i in want)
    else:
        got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in pfor.stored_ids(docs, path, None, end).collect()}
        assert got == {i: (len(w), zlib.crc32(w.tobytes())) for i, w in want.items()}


def test_transducer_of_a_whole_table_is_tiktoken(spark):
    import tiktoken

    path, pattern = queries.vocabulary(queries.MULTI_BPE)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = common.load(spark, SMALL, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_texts(docs, path, pattern).collect()}
    assert got == {i: np.array(plain.encode_ordinary(t), "<u4").tobytes() for i, t in texts.items()}


def test_labelled_junk_goes_and_clean_texts_stay(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = common.load(spark, large, "documents"), common.load(spark, large, "labels")
    # languages together, a long text, repeated rows
    more = docs.where("text is not null").limit(1).selectExpr("doc_id + 100000000 as doc_id", "repeat(concat(text, ' '), 200) as text", "lang", "source", "n_chars")
    got = quality.judged(docs.unionByName(docs).unionByName(more), labels).collect()
    twice: dict = {}
    for r in got:
        twice.setdefault(r["doc_id"], []).append((r["keep"], round(r["perplexity"], 6)))
    assert all(len(set(v)) == 1 for v in twice.values()) and sum(len(v) == 2 for v in twice.values()) == docs.count()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = ([twice[i][0][0] for i, q in marks.items() if q == k] for k in (1, 0))
    assert sum(good) >= 0.997 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_results_of_a_cluster_need_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Elsewhere()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})

    with pytest.raises(ValueError):
        common.shared_base(Session())
    with common.Work() as work:
        table = work.written(spark.range(3), "numbers")
        assert table.count() == 3
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|not exist"):
        spark.read.parquet(work.tables[0][1]).count()


def test_top_k_of_vectors_of_all_sizes(spark, monkeypatch):
    from stateflux.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 16)
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [9e6, 0.0]), (2, [0.1, 0.1])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.exact_top_k(few).orderBy("rank").collect()] == [(1, 589_824_000_000), (2, 9600)]
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.uniform(0, 16)).tolist()) for i in range(160)] + [(200, [3e16] * 6), (201, [3e16] * 6), (202, [-3e16] * 6), (203, [3e16, -3e16] * 3), (250, [3e16, -3e16, 0.0, 1.0, 1.0, 1.0])]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-s, i) for i, v in whole.items() if i != q and -(2**63) <= (s := sum(a * b for a, b in zip(whole[q], v))) < 2**63)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
