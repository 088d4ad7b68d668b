"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a bigram model over words: runs of letters, or of digits, or one
other sign. Every word of the trusted texts counts as itself, however rare; a
word that they lack gets an equal chance's share of what the model sets aside
for words after words it has not seen them follow. So the vocabulary grows with
the corpus and no task holds it. Words travel as 48-bit hashes.

Bigrams stay in shards by their first word, words in shards by their own hash.
One pass over the texts turns each stretch of about STRETCH words into numbers of
that stretch's distinct words. Each stretch lists its distinct bigrams for the
shards, with how often trusted texts have them. A shard adds up what is counted
and answers each list in its order: counts, and totals of first words. A second
exchange sums, word by word, the distinct bigrams that end in it. Answers and
texts then meet by stretch and give every text its log probability. The lists
that only ask grow with the corpus: beyond ASKING stretches a shard's are dealt on
several tasks, each with a copy of what the shard counts.

A word said over and over is improbable once and then not: a bigram model finds
such text ordinary. So the share of words that repeat the one before is held
against a quantile of trusted texts too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateflux.llm import langid
from stateflux.llm.common import Work, slices, tidy, written

#: Of the trusted texts, one in CALIBRATE is not learned from: thresholds are quantiles of their perplexities.
CALIBRATE = 5
#: Words at the mean of its language that a text's own are weighed against, so that a short text is not judged by a few words.
WEIGHT = 30
#: Words in a stretch, and shards of a language's words for every TRUSTED trusted documents or fewer. So nothing that a task holds grows with the corpus.
STRETCH, SHARDS = 1 << 21, 32
#: Words whose probabilities are computed at once.
SLICE = 1 << 18
#: Stretches whose lists one task of a shard answers, with SHARDS shards; what is counted is copied to as many tasks as that takes.
ASKING = 2048
#: Shards, and stretches, are worked off in so many passes: only a part of the lists, and of the texts on their way to the answers, is on disk at a time.
PASSES = 3
#: Trusted documents for which SHARDS shards are enough. All are counted: there are more shards if there are more of them.
TRUSTED = 1_000_000
#: The quantiles of trusted perplexity between which a text is kept, and the room beyond them in units of their distance from the median.
QUANTILES, ROOM = (0.002, 0.998), 0.25
#: The same room for the share of repeated words, and the least such limit: where trusted texts repeat nothing, a few repeats are no fault.
REPEATS_ROOM, LEAST_REPEATS = 1.0, 0.1
#: A quantile of n texts is uncertain: all languages' has the weight of FEW texts beside it, and the room grows by FEW / n.
FEW = 10.0

_word = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]").findall


def words(text: str | None) -> list[str]:
    return _word(text) if text else []


def repeats(own: list[str]) -> tuple[int, int]:
    """Of a text's words, those of letters, and how many of them are the same as the one before, whatever signs and digits are between."""
    spelled = [w for w in own if w[0].isalpha()]
    return len(spelled), sum(map(eq, spelled, islice(spelled, 1, None)))


def _placed(rows: DataFrame) -> DataFrame:
    """The rows without a language, with the one that trusted texts say they are in; those without letters with the one of most trusted texts."""
    labelled = rows.where("lang is not null and (trusted or calibrates)")
    profiles = langid.learned(labelled, "text", "lang", F.col("trusted"))
    most = labelled.where("trusted").groupBy("lang").count().orderBy(F.col("count").desc(), "lang").first()
    said = langid.identified(rows.where("lang is null"), profiles, "text", ["doc_id", "trusted", "calibrates"], carry_text=True)
    lang = F.when(F.col("lang_pred") == langid.UNKNOWN, F.lit(most["lang"] if most else langid.UNKNOWN)).otherwise(F.col("lang_pred"))
    return said.select("doc_id", lang.alias("lang"), "text", "trusted", "calibrates")


class Classes:
    """Texts to numbers, by a whole vocabulary in memory: what the sharded model is defined by. 0 is the start of a text, 1 any unseen word."""

    def __init__(self, vocabulary: dict[str, list[str]]):
        self.of = {lang: {w: 2 + i for i, w in enumerate(own)} for lang, own in vocabulary.items()}

    def size(self, lang: str) -> int:
        return 2 + len(self.of.get(lang, ()))

    def __call__(self, lang: str, text: str | None) -> np.ndarray:
        of = self.of.get(lang, {})
        return np.array([of.get(w, 1) for w in words(text)], np.int64)


def word_ids(distinct: Iterable[str]) -> np.ndarray:
    """48-bit ids of words; START has 0."""
    return np.concatenate((np.zeros(1, "<u8"), np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) >> 16 for w in distinct), "<u8")))


def packed(values: np.ndarray) -> bytes:
    """Numbers with their first bytes together, their second bytes together and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


HEAD = [("id", "<i8"), ("n", "<u4"), ("flags", "<u4"), ("spelled", "<u4"), ("again", "<u4")]
CALIBRATES, NULL_ID, TRUSTS = 1, 2, 4


def numbered(rows: DataFrame) -> DataFrame:
    """From (doc_id, lang, text, trusted, calibrates): stretches of a language's texts, as numbers of the stretch's own words, and the ids of these."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stretch, size = TaskContext.get().partitionId(), 0, 0
        held: dict[str, tuple] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal stretch, size
            for lang in list(held):
                number, texts, ids, flags, said = held.pop(lang)
                number.default_factory = None  # it refers to the numbers themselves, which else stay until Python looks for cycles
                head = np.zeros(len(ids), HEAD)
                head["id"], head["n"], head["flags"] = [i or 0 for i in ids], [len(x) for x in texts], [f | (i is None) * NULL_ID for f, i in zip(flags, ids)]
                head["spelled"], head["again"] = zip(*said)
                numbers = np.concatenate(texts)
                texts.clear()
                by_count = np.concatenate(([0], 1 + np.argsort(-np.bincount(numbers, minlength=len(number) + 1)[1:], kind="stable")))
                new = np.empty(len(by_count), "<u4")
                new[by_count] = np.arange(len(by_count))  # the most frequent get the smallest numbers, which pack best
                values = [part << 24 | stretch, lang, packed(new[numbers]), packed(head), packed(word_ids(number)[by_count])]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()])], ["stretch", "lang", "numbers", "head", "words"])
                stretch += 1
                del number, numbers, ids, flags, said, head, by_count, new, values
            size = 0

        for batch in slices(batches):
            for doc, lang, text, trusted, calibrates in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in held:
                    number: defaultdict = defaultdict()
                    number.default_factory = lambda number=number: len(number) + 1
                    held[lang] = number, [], [], [], []
                number, texts, ids, flags, said = held[lang]
                own = words(text)
                texts.append(np.fromiter(map(number.__getitem__, own), "<u4", len(own)))
                ids.append(doc)
                said.append(repeats(own))
                flags.append(calibrates * CALIBRATES | trusted * TRUSTS)
                size += len(own) + 1
                if size >= STRETCH:
                    yield from flushed()
        yield from flushed()

    return rows.select("doc_id", "lang", "text", "trusted", "calibrates").mapInArrow(tidy(work), "stretch long, lang string, numbers binary, head binary, words binary")


def bigrams(numbers: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The bigram that ends in each word of a stretch: number of the word before << 32 | its own."""
    each = np.zeros(len(numbers), np.uint64)
    each[1:] = numbers[:-1]
    each[(np.cumsum(head["n"], dtype=np.int64) - head["n"])[head["n"] > 0]] = 0
    each <<= np.uint64(32)
    each |= numbers
    return each


def counted(each: np.ndarray, trusts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams, ascending, and how often each is in trusted texts."""
    distinct = np.unique(each)
    out = np.zeros(len(distinct), np.uint32)
    found, n = np.unique(each[trusts], return_counts=True)
    out[np.searchsorted(distinct, found)] = n
    return distinct, out


def dealt(words: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each word, and the words' order by shard."""
    shard = (words % np.uint64(n_shards)).astype(np.int64)
    return shard, np.argsort(shard, kind="stable")


ASKED, COUNTED = 0, 1


def listed(texts: DataFrame, shards: range, n_shards: int = SHARDS) -> DataFrame:
    """By shard of their first word, for some shards, the bigrams of each stretch: COUNTED, those of its trusted texts with how often they occur; ASKED, the others.

    A row has the ids of first words (ASKED: of all words of the shard), how many
    bigrams each begins, the ids of distinct second words and, for each bigram,
    which of these it has.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, lang, numbers, head, ids in zip(*(c.to_pylist() for c in batch.columns)):
                numbers, head, ids = unpacked(numbers, "<u4"), unpacked(head, HEAD), unpacked(ids, "<u8")
                shard, _ = dealt(ids, n_shards)
                each, trusts = bigrams(numbers, head), np.repeat((head["flags"] & TRUSTS) > 0, head["n"])
                here = np.isin(shard, shards)[(each >> np.uint64(32)).astype(np.int32)]
                keys, n = counted(each[here], trusts[here])
                del each, trusts, here, numbers
                for kind, mine in ((ASKED, keys[n == 0]), (COUNTED, keys[n > 0])):
                    first = (mine >> np.uint64(32)).astype(np.int32)
                    fans, of = np.bincount(first, minlength=len(ids)), shard[first]
                    counts, out = n[n > 0], []
                    for s in shards:
                        own, pairs = shard == s, np.flatnonzero(of == s)
                        if kind == COUNTED:
                            own &= fans > 0
                        if own.any():
                            distinct, which = np.unique(mine[pairs].astype(np.uint32), return_inverse=True)
                            out.append((lang, s, kind, stretch, packed(ids[own]), packed(fans[own].astype("<u4")), packed(ids[distinct]), packed(which.astype("<u4")), packed(counts[pairs].astype("<u4")) if kind == COUNTED else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), LIST_TYPES)] if out else [pa.array([], t) for t in LIST_TYPES], LIST_NAMES)

    return texts.select("stretch", "lang", "numbers", "head", "words").mapInArrow(tidy(work), LIST)


LIST = "lang string, shard int, kind int, stretch long, words binary, fans binary, seconds binary, which binary, n binary"
LIST_NAMES = [x.split()[0] for x in LIST.split(", ")]
LIST_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
ANSWER = "kind int, lang string, shard int, stretch long, a binary, b binary, xs array<long>"
ANSWER_NAMES = [x.split()[0] for x in ANSWER.split(", ")]
ANSWER_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
#: Kinds of answers: of a stretch's bigrams and first words; of its words as second ones; second words of a shard; numbers for the whole language.
REPLY, COUNTED_REPLY, FOLLOWED, SECONDS, COUNTS, WHOLE = range(6)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(ANSWER_TYPES)], ANSWER_NAMES)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two word ids."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (first >> np.uint64(29))
    x = (x + second) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts (keys, counts, more columns that keys determine) as one, by ascending key."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    keys, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
    return keys, np.bincount(at, columns[1], len(keys)).astype(np.int64), *(c[first] for c in columns[2:])


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where asked numbers are in ascending keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one with whether their first three columns differ from the row before."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[:3] != last, row
            last = row[:3]


def salted(rows: DataFrame, counts: int, salts: int) -> DataFrame:
    """By (lang, shard, salt), rows of the kind ``counts`` first: these are copied to every salt, the others dealt by stretch.

    ``home`` is true of one copy of each row; salt 0 is the one that speaks for its shard.
    """
    own = F.pmod(F.xxhash64("stretch"), F.lit(salts)).cast("int")
    every = F.when(F.col("kind") == counts, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(own))
    rows = rows.withColumn("salt", F.explode(every))
    rows = rows.select("lang", "shard", "salt", (F.col("salt") == own).alias("home"), *[c for c in rows.columns if c not in ("lang", "shard", "salt")])
    return rows.repartition("lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", F.col("kind").desc())


EMPTY = tuple(np.empty(0, t) for t in ("<u8", np.int64, "<u8", "<u8"))


def answered(lists: DataFrame, salts: int = 1, n_shards: int = SHARDS) -> DataFrame:
    """Shard by shard: the trusted counts of the bigrams asked for, and totals and types of their first words.

    REPLY and COUNTED_REPLY rows are in the order of the stretch's own words and
    bigrams. What a shard counts waits, packed, for the sums: it is of about
    TRUSTED / SHARDS texts. What is only asked for streams past. SECONDS
    rows go to the shards of second words, with the number of distinct bigrams
    each has; COUNTS rows say how many bigrams occur one to four times.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, table = None, [], None
        waiting: list[tuple] = []

        def spread(a: bytes, fans: bytes, seconds: bytes, which: bytes) -> tuple[np.ndarray, ...]:
            first, second = np.repeat(unpacked(a, "<u8"), unpacked(fans, "<u4")), unpacked(seconds, "<u8")[unpacked(which, "<u4")]
            return _pair(first, second), (first, second)

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal table, left, sums
            table = _merged(parts) if parts else EMPTY
            _, n, first, second = table
            left, at = np.unique(first, return_inverse=True)
            sums = np.array([np.bincount(at, w, len(left)) for w in (n, n == 1, n == 2, n > 2)]).astype("<u8")
            for stretch, rest in waiting:
                keys, _ = spread(*rest)
                yield _answers([(COUNTED_REPLY, *group[:2], stretch, packed(n[_found(table[0], keys)[0]].astype("<u4")), None, None)])
            waiting.clear()
            if len(n) and speaks:
                distinct, types = np.unique(second, return_counts=True)
                shard, order = dealt(distinct, n_shards)
                ends = np.searchsorted(shard[order], np.arange(n_shards + 1))
                out = [(SECONDS, group[0], s, None, packed(distinct[own]), packed(types[own].astype("<u8")), None) for s in range(n_shards) for own in [order[ends[s] : ends[s + 1]]] if len(own)]
                yield _answers([*out, (COUNTS, group[0], None, None, None, None, [int((n == k).sum()) for k in (1, 2, 3, 4)])])

        left, sums, speaks = None, None, True
        for new, (lang, shard, salt, home, kind, stretch, *rest, n) in _grouped(batches):
            if new:
                if group and table is None:
                    yield from closed()
                group, parts, table, speaks = (lang, shard, salt), [], None, salt == 0
            keys, pairs = spread(*rest)
            if kind == COUNTED:
                if home:
                    waiting.append((stretch, rest))
                parts.append((keys, unpacked(n, "<u4").astype(np.int64), *pairs))
                if len(parts) > 64:
                    parts = [_merged(parts)]
                continue
            if table is None:
                yield from closed()
            at, there = _found(table[0], keys)
            n = np.where(there, table[1][at], 0) if len(table[0]) else np.zeros(len(keys), np.int64)
            firsts = unpacked(rest[0], "<u8")
            at, there = _found(left, firsts)
            own = np.where(there, sums[:, at], 0) if len(left) else np.zeros((4, len(firsts)), "<u8")
            yield _answers([(REPLY, lang, shard, stretch, packed(n.astype("<u4")), packed(own.astype("<u8").ravel()), None)])
        if group and table is None:
            yield from closed()

    return salted(lists, COUNTED, salts).mapInArrow(tidy(work), ANSWER)


def followed(texts: DataFrame, answers: DataFrame, salts: int = 1, n_shards: int = SHARDS) -> DataFrame:
    """Shard by shard of second words: in how many distinct trusted bigrams each of a stretch's words is second, and WHOLE rows.

    A WHOLE row has the number of words of its shard, the sum of their bigrams, and how many words have one, two, three, four, and three or more.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, lang, ids in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpacked(ids, "<u8")
                shard, _ = dealt(ids, n_shards)
                yield _answers([(FOLLOWED, lang, s, stretch, packed(ids[shard == s]), None, None) for s in np.unique(shard).tolist()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, table = None, [], None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal table
            table = _merged(parts) if parts else EMPTY[:2]
            n = table[1]
            if len(n) and group[2] == 0:
                yield _answers([(WHOLE, *group[:2], None, None, None, [len(n), int(n.sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n > 2).sum())])])

        for new, (lang, shard, salt, _, kind, stretch, a, b) in _grouped(batches):
            if new:
                if group and table is None:
                    yield from closed()
                group, parts, table = (lang, shard, salt), [], None
            ids = unpacked(a, "<u8")
            if kind == SECONDS:
                parts.append((ids, unpacked(b, "<u8").astype(np.int64)))
                if len(parts) > 64:
                    parts = [_merged(parts)]
                continue
            if table is None:
                yield from closed()
            at, there = _found(table[0], ids)
            n = np.where(there, table[1][at], 0) if len(table[0]) else np.zeros(len(ids), np.int64)
            yield _answers([(FOLLOWED, lang, shard, stretch, packed(n.astype("<u8")), None, None)])
        if group and table is None:
            yield from closed()

    rows = texts.select("stretch", "lang", "words").mapInArrow(tidy(asked), ANSWER).union(answers.where(F.col("kind") == SECONDS))
    return salted(rows.select("lang", "shard", "kind", "stretch", "a", "b"), SECONDS, salts).mapInArrow(tidy(work), ANSWER)


def discounts(n: list[int]) -> np.ndarray:
    """Chen and Goodman's three discounts from the numbers of n-grams that occur one to four times; at most the count, at least 0."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))])


class Model:
    """Bigram probabilities of a language, for words numbered below ``size``, but for the counts of bigrams themselves.

    ``left`` has (word, total, types that occur once, twice, more often), ``right``
    (word, distinct bigrams it is second in). If they are not of all words,
    ``whole`` has what followed() says of all; else it follows from ``right``.
    A word that was never seen has an equal chance's share of what is set aside.
    """

    def __init__(self, size: int, left, right, counts: list[int], whole: list[int] | None = None):
        left, right = np.array(left, np.int64).reshape(-1, 5), np.array(right, np.int64).reshape(-1, 2)
        self.d = discounts(counts)
        self.total, weight, follows = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        self.total[left[:, 0]], weight[left[:, 0]] = left[:, 1], left[:, 2:] @ self.d[1:]
        follows[right[:, 0]] = right[:, 1]
        if whole is None:
            whole = [size - 2, int(follows.sum()), *(int((follows == k).sum()) for k in (1, 2, 3, 4)), int((follows > 2).sum())]
        lower, everything = discounts(whole[2:6]), max(1, whole[1])
        kept = np.maximum(follows - lower[np.minimum(follows, 3)], 0.0)
        spare = float(np.dot(lower[1:], [whole[2], whole[3], whole[6]])) if whole[1] else 1.0
        self.single = (kept + spare / (whole[0] + 2)) / everything  # equal chances for all words, the start and an unseen word
        self.back = np.where(self.total > 0, weight / np.maximum(self.total, 1), 1.0)

    def log(self, before: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The log probabilities of words after those before them, with the trusted counts of these bigrams."""
        kept = np.maximum(counts - self.d[np.minimum(counts, 3)], 0.0) / np.maximum(self.total[before], 1)
        return np.log(kept + self.back[before] * self.single[own] + 1e-300)


def wholes(answers: DataFrame, follows: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """For each language with trusted text, the sums of its COUNTS and of its WHOLE rows: a few numbers."""
    out: dict[str, dict[int, list[int]]] = {}
    for kind, n, table in ((COUNTS, 4, answers), (WHOLE, 7, follows)):
        for r in table.where(F.col("kind") == kind).groupBy("lang").agg(*[F.sum(F.col("xs")[i]).alias(f"x{i}") for i in range(n)]).collect():
            out.setdefault(r["lang"], {})[kind] = [r[f"x{i}"] for i in range(n)]
    return {lang: (own[COUNTS], own[WHOLE]) for lang, own in out.items()}


def scored(texts: DataFrame, answers: DataFrame, follows: DataFrame, known: dict[str, tuple[list[int], list[int]]], n_shards: int = SHARDS) -> DataFrame:
    """doc_id, lang, calibrates, n_words, n_spelled, n_again, log_prob (null where the language has no model) of every text; a stretch's answers come before its texts."""
    kinds = "doc_id long, lang string, calibrates boolean, n_words long, n_spelled long, n_again long, log_prob double"
    names = [x.split()[0] for x in kinds.split(", ")]
    number = "u1" if n_shards <= 256 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {}
        for batch in batches:
            for stretch, kind, lang, shard, a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if stretch != now:
                    now, parts = stretch, {}
                if kind < SECONDS:
                    parts[kind, shard] = a, b
                    continue
                own, head = unpacked(a, "<u4"), unpacked(b, HEAD)
                ends = np.cumsum(head["n"], dtype=np.int64)
                logs: list = [None] * len(head)
                if lang in known:
                    each = bigrams(own, head)
                    keys, place = np.unique(each, return_inverse=True)
                    trusted = np.zeros(len(keys), bool)
                    trusted[place[np.repeat((head["flags"] & TRUSTS) > 0, head["n"])]] = True
                    shard = unpacked(ids, number).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    of = shard[(keys >> np.uint64(32)).astype(np.int32)]
                    shards, counts, left, right = np.unique(shard).tolist(), np.zeros(len(keys), np.int64), np.zeros((len(order), 5), np.int64), np.zeros((len(order), 2), np.int64)
                    left[:, 0] = right[:, 0] = order
                    replies = [parts[REPLY, s] for s in shards]
                    for s in shards:
                        counts[~trusted & (of == s)] = unpacked(parts[REPLY, s][0], "<u4")
                        if (COUNTED_REPLY, s) in parts:
                            counts[trusted & (of == s)] = unpacked(parts[COUNTED_REPLY, s][0], "<u4")
                    left[:, 1:] = np.concatenate([unpacked(x, "<u8").reshape(4, -1).T for _, x in replies])
                    right[:, 1] = np.concatenate([unpacked(parts[FOLLOWED, s][0], "<u8") for s in shards])
                    model = Model(len(order), left, right, *known[lang])
                    sums = np.zeros(len(own) + 1)
                    for at in range(0, len(own), SLICE):
                        some = each[at : at + SLICE]
                        sums[at + 1 : at + 1 + len(some)] = model.log((some >> np.uint64(32)).astype(np.int64), own[at : at + SLICE], counts[place[at : at + SLICE]])
                    np.cumsum(sums, out=sums)
                    logs = (sums[ends] - sums[ends - head["n"]]).tolist()
                docs = [None if f & NULL_ID else i for i, f in zip(head["id"].tolist(), head["flags"].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([lang] * len(head), pa.string()), pa.array((head["flags"] & CALIBRATES) > 0), *(pa.array(head[c].astype(np.int64)) for c in ("n", "spelled", "again")), pa.array(logs, pa.float64())], names)

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the words' ids only the shards are needed any more
        for batch in batches:
            for stretch, lang, numbers, head, ids in zip(*(c.to_pylist() for c in batch.columns)):
                shard, _ = dealt(unpacked(ids, "<u8"), n_shards)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((stretch, WHOLE, lang, None, numbers, head, packed(shard.astype(number))), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["stretch", "kind", "lang", "shard", "a", "b", "words"])

    none = F.lit(None).cast("binary").alias("words")
    last = texts.select("stretch", "lang", "numbers", "head", "words").mapInArrow(tidy(sorted_out), "stretch long, kind int, lang string, shard int, a binary, b binary, words binary")
    replies = [x.where(F.col("kind") == k).select("stretch", "kind", "lang", "shard", "a", "b", none) for x, k in ((answers, REPLY), (answers, COUNTED_REPLY), (follows, FOLLOWED))]
    return reduce(DataFrame.union, [*replies, last]).repartition("stretch").sortWithinPartitions("stretch", "kind").mapInArrow(tidy(work), kinds)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", row: str | None = None) -> DataFrame:
    """doc_id, lang, n_words, perplexity, low, high, repeats, most_repeats, keep of every row.

    Trusted are all documents that ``labels`` (doc_id, quality) calls 1. One in
    CALIBRATE of them is held out from the counts; the quantiles of their perplexities, widened by
    ROOM, are their language's limits, low and high. The log probability of a
    text is taken together with WEIGHT words at its language's mean, so that a
    few words alone cannot fail. Symbols, shouting and text of unseen words lie
    above the high limit; repeated frequent words lie below the low one.
    A repeated rare word may lie between: ``repeats`` is the share of a text's
    words of letters that are the same as the one before, taken together with
    WEIGHT words at the mean, and most_repeats its limit, found likewise
    but with REPEATS_ROOM and never under LEAST_REPEATS.

    A text is kept if both are within the limits or if there are none:
    its language is named and has no trusted text that is counted or none
    that is held out, so nothing is known of its good texts. At any
    number n of held-out texts a language's quantiles are its own with weight n
    and, with weight FEW, those of all languages' distances from their means.
    Null and empty texts have 0 words and the
    means, and are kept; a text of any length is judged whole. An empty table
    gives no rows, other columns are ignored. A null language is
    replaced, in the result too, by the one that profiles of the trusted texts
    predict (``und`` if there are none). Repeated rows are
    each judged; a doc_id that is labelled twice counts once. With ``row``, a
    column of numbers that tells apart rows with one doc_id, that column stands
    in the result in doc_id's place.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct()
    n_good = good.count()
    times = max(1, -(-n_good // TRUSTED))
    n_shards, more = SHARDS * times, {"n_shards": SHARDS * times} if times > 1 else {}
    rows = docs.select(F.col(doc_id).cast("long").alias("named"), F.col(row or doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(good) if times == 1 else good, F.col("named") == F.col("trusted_id"), "left")  # at most TRUSTED ids of 8 bytes are sent to all tasks
    labelled, held = F.col("trusted_id").isNotNull(), F.pmod(F.xxhash64("named", F.lit(11)), F.lit(CALIBRATE)) == 0
    rows = rows.select("doc_id", "lang", "text", (labelled & ~held).alias("trusted"), (labelled & held).alias("calibrates"))
    rows = rows.where("lang is not null").unionByName(_placed(rows)) if not rows.where("lang is null").isEmpty() else rows
    with Work() as work:
        texts = work.written(numbered(rows), "numbers")
        passes = [range(i, n_shards, PASSES) for i in range(PASSES)]
        salts = -(-max(1, texts.count()) // (ASKING * times))  # lists are shorter where there are more shards
        answers = reduce(DataFrame.union, [work.written(answered(listed(texts, shards, **more), salts, **more), "counts") for shards in passes])
        follows = work.written(followed(texts, answers, salts, **more), "follows")
        known, mine = wholes(answers, follows), lambda i: F.pmod(F.xxhash64("stretch"), F.lit(PASSES)) == i
        result = reduce(DataFrame.union, [written(scored(texts.where(mine(i)), answers.where(mine(i)), follows.where(mine(i)), known, **more), "scores") for i in range(PASSES)])
    return limited(result)


def limited(result: DataFrame) -> DataFrame:
    """What :func:`judged` says of every row of :func:`scored`: two statistics, their limits by language, and whether both are within."""
    measures = ["perplexity", "low", "high", "repeats", "most_repeats"]
    out = lambda keep, **known: result.select("doc_id", "lang", "n_words", *[known.get(c, F.lit(None).cast("double")).alias(c) for c in measures], keep.alias("keep"))
    own = result.where("calibrates and log_prob is not null and n_words > 0")
    means = own.groupBy("lang").agg(F.sum("log_prob").alias("log"), *[F.sum(c).alias(c) for c in ("n_words", "n_spelled", "n_again")]).collect()
    if not means:
        return out(F.lit(True))
    mean_of = {r["lang"]: (-r["log"] / r["n_words"], r["n_again"] / max(1, r["n_spelled"])) for r in means}
    by_lang = lambda of: F.create_map(*[F.lit(x) for lang, value in sorted(of.items()) for x in (lang, float(value))])[F.col("lang")]
    mean, usual = (by_lang({lang: m[i] for lang, m in mean_of.items()}) for i in (0, 1))
    result = result.withColumn("bits", (WEIGHT * mean - F.col("log_prob")) / (WEIGHT + F.col("n_words")))
    result = result.withColumn("repeats", (WEIGHT * usual + F.col("n_again")) / (WEIGHT + F.col("n_spelled")))
    held, shares = result.where("calibrates and n_words > 0"), [QUANTILES[0], 0.5, QUANTILES[1]]
    quantiles = lambda column: F.percentile_approx(column, shares, 100_000)
    limits = held.groupBy("lang").agg(quantiles("bits").alias("q"), quantiles("repeats").alias("r"), F.count("bits").alias("n")).collect()
    # all languages together, each as far from its own mean
    others = held.agg(quantiles(F.col("bits") - mean).alias("q"), quantiles(F.col("repeats") - usual).alias("r")).first()
    ends: dict[str, tuple[float, float, float]] = {}
    for r in limits:
        if r["q"]:
            mine, more = r["n"] / (r["n"] + FEW), FEW / r["n"]
            both = lambda of, m: (mine * own_ + (1 - mine) * (m + other) for own_, other in zip(r[of], others[of]))
            first, middle, last = both("q", mean_of[r["lang"]][0])
            _, common, most = both("r", mean_of[r["lang"]][1])
            ends[r["lang"]] = first - (ROOM + more) * (middle - first), last + (ROOM + more) * (last - middle), max(LEAST_REPEATS, most + (REPEATS_ROOM + more) * (most - common))
    if not ends:
        return out(F.lit(True), perplexity=F.exp("bits"), repeats=F.col("repeats"))
    low, high, most = (by_lang({lang: e[i] for lang, e in ends.items()}) for i in range(3))
    keep = F.coalesce(F.col("bits").between(low, high) & (F.col("repeats") <= most), F.lit(True))
    return out(keep, perplexity=F.exp("bits"), low=F.exp(low), high=F.exp(high), repeats=F.col("repeats"), most_repeats=most)
