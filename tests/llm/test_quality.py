"""The quality model against its formulas written out anew, shards dealt on several tasks, repeated words."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from stateflux.llm import quality

SPLIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]").findall


def discount(counts):
    """Chen and Goodman: D1, D2, D3+ of a table of counts."""
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return {1: 1 - 2 * y * n2 / n1, 2: 2 - 3 * y * n3 / n2, 3: 3 - 4 * y * n4 / n3}


def log_probabilities(trusted, texts):
    """Interpolated modified Kneser-Ney by dictionaries: the log probability of every text's words, each after the one before, the first after a start."""
    pairs = Counter(p for t in trusted for p in zip(["<s>", *t], t))
    d = discount(pairs.values())
    ends = Counter(w for _, w in pairs)  # distinct words that a word follows
    e = discount(ends.values())
    spare = sum(e[min(c, 3)] for c in ends.values()) / sum(ends.values())
    single = lambda w: (max(ends[w] - e[min(ends[w], 3)], 0) if w in ends else 0) / sum(ends.values()) + spare / (len(ends) + 2)

    total, aside = Counter(), Counter()
    for (u, _), c in pairs.items():
        total[u] += c
        aside[u] += d[min(c, 3)]

    def after(u, w):
        if not total[u]:
            return single(w)
        c = pairs[u, w]
        return ((c - d[min(c, 3)]) if c else 0) / total[u] + aside[u] / total[u] * single(w)

    return [sum(math.log(after(u, w)) for u, w in zip(["<s>", *t], t)) for t in texts]


def made(rng, alphabet, n):
    """Texts whose words and bigrams occur one to five times and more."""
    vocabulary = ["".join(rng.choices(alphabet, k=rng.randrange(1, 5))) for _ in range(250)]
    weights = [1 / (1 + i) for i in range(250)]
    return [" ".join(w if rng.random() < 0.9 else w + "," for w in rng.choices(vocabulary, weights, k=rng.randrange(4, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(31)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "aa") for t in made(rng, "abcde", 120)), *((t, "bb") for t in made(rng, "vwxyz", 90)), ("new words here, 7 of them", "aa"), ("zz zz abc", "bb"), ("", "aa"), (None, "bb")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(0, 210).where("id % 10 < 8").selectExpr("id as doc_id", "1 as quality")
    return rows, docs.repartition(5), labels


def test_perplexities_against_the_formulas(spark, case):
    rows, docs, labels = case
    good = {r["doc_id"] for r in labels.collect()}
    held = {r["doc_id"] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 11), {quality.CALIBRATE}) = 0 as h").where("h").collect()} & good
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    for lang in ("aa", "bb"):
        texts = {i: SPLIT(t or "") for i, t, own in rows if own == lang}
        trusted = [texts[i] for i in texts if i in good - held]
        assert set(range(1, 6)) <= set(Counter(p for t in trusted for p in zip(["<s>", *t], t)).values())
        logs = dict(zip(texts, log_probabilities(trusted, texts.values())))
        mean = -sum(logs[i] for i in held & texts.keys()) / sum(len(texts[i]) for i in held & texts.keys())
        for i, t in texts.items():
            assert got[i]["n_words"] == len(t)
            assert abs(math.log(got[i]["perplexity"]) - (quality.WEIGHT * mean - logs[i]) / (quality.WEIGHT + len(t))) < 1e-9


def test_shards_dealt_on_several_tasks(spark, case, monkeypatch):
    rows, docs, labels = case
    want = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    monkeypatch.setattr(quality, "ASKING", 1)  # every stretch is asked about in a task of its own
    salts, plain = [], quality.answered
    monkeypatch.setattr(quality, "answered", lambda lists, n: salts.append(n) or plain(lists, n))
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert salts[0] >= 8 and got.keys() == want.keys()
    for i, r in want.items():
        assert abs(got[i]["perplexity"] - r["perplexity"]) < 1e-9 and got[i]["keep"] == r["keep"] and abs(got[i]["high"] - r["high"]) < 1e-9


def test_all_trusted_texts_count_however_many(spark, case, monkeypatch):
    rows, docs, labels = case
    want = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    good = labels.where("quality = 1").distinct().count()
    monkeypatch.setattr(quality, "TRUSTED", good // 9)  # more than 256 shards
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert abs(got[i]["perplexity"] - r["perplexity"]) < 1e-9 and got[i]["keep"] == r["keep"] and abs(got[i]["high"] - r["high"]) < 1e-9


def test_repeated_words(spark, case):
    assert quality.repeats([]) == (0, 0) and quality.repeats(SPLIT("no. no, no 5 no yes 7 7")) == (5, 3)
    rows, docs, labels = case
    rng = random.Random(32)
    again = [" ".join(w for w in t.split() for _ in range(12)) for t in made(rng, "abcde", 20)]
    tables = [" | ".join(t.split()) for t in made(rng, "abcde", 5)]
    more = spark.createDataFrame([(1000 + i, t, "aa") for i, t in enumerate([*again, *tables, "abc abc"])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judged(docs.union(more), labels).collect()}
    assert all(got[1000 + i]["repeats"] > got[1000 + i]["most_repeats"] and not got[1000 + i]["keep"] for i in range(20))
    # signs between words repeat nothing, and two equal words are no fault
    assert all(got[1000 + i]["repeats"] <= got[1000 + i]["most_repeats"] for i in range(20, 26))
    assert all(got[i]["repeats"] <= got[i]["most_repeats"] for i in range(210)) and got[212]["keep"] and got[213]["keep"]

