"""The manifest, personal data and source divergence against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from stateflux.llm import divergence, merkle, pii

CLASHES = "doc_id long, text string, lang string, source string, n_chars long, g string, h int, k long, leaf string, rank int, total int, spans string, n int, p int, q int, item string, term string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, 2, "leaf", 3, 4, "s", 5, 6, 7, "i", "t", 8) for r in rows], CLASHES)


# -- manifest


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row) -> str:
    doc_id, text, lang, source, n = row
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_definition(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in langs[x]]) for x in names}
    top = tree([trees[x][-1][0] for x in names])
    root, out = top[-1][0] if names else None, []
    for j, x in enumerate(names):
        above = list(steps(top, j))
        for i, r in enumerate(langs[x]):
            way = [*steps(trees[x], i), *above]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((r[0], lowered(r[1]), *r[2:])) if changed else leaf(r)
            for before, after in way:
                now = sha(before + now + after)
            out.append((r[0], leaf(r), trees[x][-1][0], root, sha("".join(a + b for a, b in way)), now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(spark, rows):
    got = [tuple(r) for r in merkle.manifest(table(spark, rows)).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(by_definition(rows), key=repr)


def test_manifest_of_odd_rows(spark):
    rows = [(1, "One A", "en", "s", 3), (2, "TWO", "de", None, None), (3, None, "en", "", 0), (None, "no id", "en", "s", 1), (None, "none", "en", "s", 1), (None, "no id", "en", "s", 1)]
    rows += [(7, "seven", "en", "s", 1)] * 11 + [(7, "SEVEN", "en", "s", 1), (7, "Seven", "en", "t", 1)]  # one id, equal and unequal rows
    rows += [(-5, "", None, "s", -1), (-(2**63), "least É", None, "s", 1), (2**63 - 1, "greatest", None, "s", 1), (0, "alone", "", "s", 1), (4, "x" * 200_000 + "Y", "é", "s", 2)]
    check_manifest(spark, rows)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(table(spark, [])).count() == 0
    check_manifest(spark, [(9, "ONE", "en", "s", 1)])
    check_manifest(spark, [(3, "A", "en", "s", 1), (6, "B", "fr", "s", 1)])
    check_manifest(spark, [(i, f"Text {i}", "en", "s", i) for i in range(8)])


def test_manifest_of_several_passes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGIT", 4)
    monkeypatch.setattr(merkle, "COPIES", 16)
    monkeypatch.setattr(merkle, "PART", 7)
    rng = random.Random(5)
    rows = [(rng.randrange(-(10**6), 10**6), f"Text {i}", "en", "s", i) for i in range(4500)]  # more than a chunk
    rows += [(77, f"HOT {i % 900}", "en", "s", 1) for i in range(1500)]  # a hot id
    rows += [(i, "T", f"l{i % 300}", "s", 1) for i in range(700)]  # many languages
    check_manifest(spark, rows)


# -- personal data


def plainly(text):
    """By the kinds' expressions as they stand."""
    base = []
    for i, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.SPEC[kind].pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = True
            if kind == "ip":
                good = all(int(x) <= 255 for x in m.group().split("."))
            elif kind == "card":
                total = 0
                for j, d in enumerate(reversed(digits)):
                    v = int(d) * (1 + j % 2)
                    total += v // 10 + v % 10
                good = 14 <= len(digits) <= 19 and total % 10 == 0
            elif kind == "phone":
                good = 10 <= len(digits) <= 15
            if good:
                base.append((m.start(), i, m.end()))
    return [(kind, a, b) for a, i, b in sorted(base) for kind in [pii.BASE[i]]]


def based(text):
    return [(pii.KINDS[i], a, b) for a, b, i, _ in pii.spans(text) if i < len(pii.BASE)]


def test_base_spans_are_those_of_the_expressions():
    rng = random.Random(3)
    for alphabet in ("a.@-b1", "0123456789 -", "01.2 .", "+0123456789().- x", "ab@c.é+1 -.9(5)\n4"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
            assert based(text) == plainly(text), text
    for text in ("a@b.c@d.e", "@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.4", "+1 (136) 555-7479%%", "4111 1111-1111 1111", "41111111111111110", "é🙂 4111111111111111 é", "x@y", "+12345678901234567", "１２３４５６７８９０１２３４"):
        assert based(text) == plainly(text), text


def account(country, rest):
    return next(f"{country}{c:02d}{rest}" for c in range(2, 99) if pii.mod97(f"{country}{c:02d}{rest}"))


def test_spans_beyond_the_base():
    names = lambda text: [pii.KINDS[i] for _, _, i, _ in pii.spans(text)]
    good = account("DE", "370400440532013000")
    spaced = " ".join(good[i : i + 4] for i in range(0, len(good), 4))
    assert names(f"IBAN {spaced}, thanks") == ["iban"] and names(f"pay {good} now") == ["iban"]
    assert "iban" not in names(f"IBAN {good[:-1]}{(int(good[-1]) + 1) % 10}")
    assert names("SSN: 123-45-6789") == ["ssn"] and names("part 123-45-6789") == [] and names("SSN: 000-45-6789") == []
    assert names("call 555-234 or 415-555-2671") == ["national"] and names("range 415-555-2671") == []
    assert names("call +1 415-555-2671") == ["phone"]  # not twice
    scores = {pii.KINDS[i]: s for _, _, i, s in pii.spans("my mail is a@b.cd. " + "." * 80 + " example version 1.2.3.4")}
    assert scores["email"] > pii.SPEC["email"].score and scores["ip"] < pii.SPEC["ip"].score


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "a@" * 500_000, "a@b." * 500_000, "1.1." * 500_000, "+1(" * 500_000, "DE12 " * 400_000):
        pii.spans(text)
    assert time.time() - began < 40


def test_personal_data_of_odd_rows(spark):
    texts = [None, "", "  ", "mail a@b.cd and a@b.cd", "é" * 1000 + " 10.0.0.1", "w " * 100_000 + "+49 30 1234 5678", "4111-1111-1111-1111"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[4], "en", "s", 1)]
    got = sorted(map(tuple, pii.audit(table(spark, rows)).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        base = plainly(t or "")
        listed, n = ",".join(f"{k}:{a}:{b}" for k, a, b in base), Counter(k for k, _, _ in base)
        want.append((i, *(n[k] for k in pii.BASE), sha(listed), listed))
    assert got == sorted(want, key=repr)
    assert pii.audit(table(spark, [])).count() == 0


# -- divergence


def diverging(rows, least, most):
    docs = [(l or "", s or "", [re.sub("[A-Z]", lambda c: c.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, l, s, _ in rows]
    groups = sorted({(l, s) for l, s, _ in docs})
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for l, s, words in docs:
        df[l].update(set(words))
        counts[l, s].update(words)
    out = []
    for l in {l for l, _ in groups}:
        kept = [t for t, d in df[l].items() if d >= least]
        sources = [s for x, s in groups if x == l]
        total = {t: sum(counts[l, s][t] for s in sources) for t in kept}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[l, s]) for s in sources}, shares(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[l, s][t] > 0 and p[s][t] > q[t])[:most]
            out += [(l, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_divergence_of_odd_rows(spark):
    rng = random.Random(8)
    words = [f"W{chr(97 + i)}{'é' * (i % 3)}" for i in range(26)] + ["ÉÀ", "ſK", "a", "A"]
    rows = [(i % 50, " ".join(rng.choices(words, weights=range(1, 31), k=rng.randrange(40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "", "Z"]), 1) for i in range(400)]
    rows += [(None, None, "xx", "only", 1), (1, None, "yy", "a", 1), (1, "unseen words", "yy", "b", 1), (1, "1 2 3", "yy", None, 1), (1, "word " * 50_000, "en", "long", 1)]
    for least, most in ((3, 200), (1, 4)):
        got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), least, most).collect())
        assert got == diverging(rows, least, most)
    assert divergence.audit(table(spark, [])).count() == 0


def test_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 3)
    rows = [(i, f"alpha beta {'gamma ' * (i % 5)} w{chr(97 + i % 20)}", "en", f"s{i % 4}", 1) for i in range(120)]
    assert sorted(tuple(r) for r in divergence.audit(table(spark, rows)).collect()) == diverging(rows, 3, 200)


@pytest.mark.parametrize("count,size,terms", [(0, 0, 1), (4 * 10**18, 4 * 10**18, 10**9), (7, 10**15, 3), (12345678901, 98765432109, 4321)])
def test_shares_are_exact(spark, count, size, terms):
    got = spark.range(1).selectExpr(f"{count}L as a", f"{size}L as b", f"{terms}L as c").select(divergence._share("a", "b", "c")).first()[0]
    assert got == 1 + 10**9 * (count + 1) // (size + terms)


def test_what_is_written_reaches_python_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from stateflux.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    before = [spark.conf.get(c) for c in (common.BATCH, common.CLEANUP)]
    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("word "), 600).alias("text"))  # 27 MB in one part
    found = common.written(texts.mapInArrow(sizes, "size long, n long"), "sizes").collect()
    assert sum(r["n"] for r in found) == 9000 and len(found) > 4 and max(r["size"] for r in found) < 8 << 20
    assert [spark.conf.get(c) for c in (common.BATCH, common.CLEANUP)] == before
