"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

The tokens of a text's prefixes decide those of the text: a prefix that ends
at byte i has one last token, the token t among the suffixes at i such that
the last token of the prefix before t, followed by t, is itself an encoding.
What the transducer must remember is therefore small: the bytes that may still
grow into a token, and the last token at each place among them. Such memories
are its states. They are made when first met, numbered, and joined by a table
(state, byte) -> (state, tokens emitted); a token leaves as soon as all places
that are still open agree on it, a bounded number of bytes after its end.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import slices, tidy

#: Entries of a memo table before it is emptied; results do not depend on it.
MEMO = 1 << 18
#: States of a transducer, and entries of its tables, before it starts anew; results do not depend on them.
STATES, ENTRIES = 1 << 20, 1 << 21
#: Bytes of a piece that are read before the tables' sizes are looked at again.
STRIDE = 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def merged(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """The definition: join the pair of lowest rank, leftmost first, until no pair has a rank (or ``least`` parts are left)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 40:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[x] for x in parts]


class Transducer:
    """Encodes pieces. ``step`` and ``finish`` read a byte and the end; ``encode`` runs a whole piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.length = {v: len(k) for k, v in ranks.items()}
        self.open = {t[:n] for t in ranks for n in range(1, len(t))}  # what may grow into a token
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.fits: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.start = self._state((b"", 0, -1))

    def _state(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or where merges are not in order of rank."""
        found = self.made.get(token, 0)
        if found == 0:
            parts, found = merged(self.tokens[token], self.ranks, 2), None
            if len(parts) == 2 and self.ranks[self.tokens[parts[0]] + self.tokens[parts[1]]] == token and max(parts) < token:
                found = parts[0], parts[1]
            self.made[token] = found
        return found

    def _fit(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: the start of a piece).

        Both tokens are undone merge by merge, the later one first; the pair that
        meets at the border at each time must not have been the next to merge.
        """
        found = self.fits.get(before << 32 | token)
        if found is not None:
            return found
        if before < 0:
            found = merged(self.tokens[token], self.ranks) == [token]
        elif not self._fit(-1, token):
            found = False
        else:
            left, right, left_gone, right_gone, found = before, token, 1 << 40, 1 << 40, True
            while True:
                rank = self.ranks.get(self.tokens[left] + self.tokens[right])
                if rank is not None and rank < left_gone and rank <= right_gone:
                    found = False
                    break
                one, two = len(self.tokens[left]) == 1, len(self.tokens[right]) == 1
                if one and two:
                    break
                if two or not one and left > right:
                    halves, left_gone = self._halves(left), left
                    left = halves[1] if halves else -1
                else:
                    halves, right_gone = self._halves(right), right
                    right = halves[0] if halves else -1
                if not halves:
                    found = merged(self.tokens[before] + self.tokens[token], self.ranks) == [before, token]
                    break
        self.fits[before << 32 | token] = found
        return found

    def _next(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        # A state: the open bytes, then for each place, the furthest first, the bytes since and the last token there.
        # The first place is the root, which all chains of tokens come from; the place before another is its token's length away.
        seen, *flat = self.states[state]
        text, size, length = seen + bytes([byte]), len(seen) + 1, self.length
        last, live, new = {}, [], -1
        for back, token in zip(flat[::2], flat[1::2]):
            back += 1
            last[back] = token
            if back <= size:
                part = text[size - back :]
                if new < 0 and (found := self.ranks.get(part)) is not None and self._fit(token, found):
                    new = found
                if part in self.open:  # a later token can still begin here
                    live.append(back)
        last[0] = new
        live.append(0)
        root, above = flat[0] + 1, {}  # above: for each place, those whose chain goes on from it
        for place in live:
            while place != root:
                prior = place + length[last[place]]
                if prior in above:
                    if place not in above[prior]:
                        above[prior].append(place)
                    break
                above[prior] = [place]
                place = prior
        out = []
        while root not in live and len(above[root]) == 1:  # all chains go through the next place: its token is certain
            root = above.pop(root)[0]
            out.append(last[root])
        next_ = [text[size - live[0] :]]
        for place in sorted({root, *live, *above}, reverse=True):
            next_ += place, last[place]
        return self._state(tuple(next_)), tuple(out)

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        key = state << 8 | byte
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = self._next(state, byte)
        return found

    def finish(self, state: int) -> list[int]:
        """The tokens still held back, when the piece ends here."""
        flat = self.states[state]
        last, place, out = dict(zip(flat[1::2], flat[2::2])), 0, []
        while place != flat[1]:
            out.append(last[place])
            place += self.length[last[place]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token, reachable by merges or not
            return [whole]
        state, out = self.start, []
        for at in range(0, len(piece), STRIDE):
            state = self._room(state)
            table = self.table
            for byte in piece[at : at + STRIDE]:
                found = table.get(state << 8 | byte)
                if found is None:
                    found = self.step(state, byte)
                state, said = found
                if said:
                    out.extend(said)
        return out + self.finish(state)

    def _room(self, state: int) -> int:
        """The number of the same state, after the tables were emptied if they had grown too large."""
        if len(self.states) <= STATES and max(len(self.fits), len(self.table)) <= ENTRIES:
            return state
        memory = self.states[state]
        self._reset()
        return self._state(memory)


class Encoder(dict):
    """Texts to token ids as little-endian 32-bit integers; a bounded memo of pieces, filled by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}  # what was in the memo before it was last emptied

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = struct.pack(f"<{len(out := self.transducer.encode(piece.encode('utf-8', 'surrogatepass')))}I", *out)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))


class Utf8:
    """An incremental UTF-8 state machine: bytes in, whole characters out.

    The state is (bytes still wanted, the range the next byte must be in, the
    bytes read). Bytes that cannot go on become U+FFFD, one for each longest
    valid beginning, as the Unicode standard recommends. Only the last three
    bytes of a chunk can be unfinished, so the machine runs over those and
    whole characters before them are converted at once.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for n in range(1, min(3, len(data)) + 1):
            lead = data[-n]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                want = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if want <= n:
                    return 0
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                return n if n == 1 or low <= data[1 - n] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Token ids to bytes and, incrementally, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def stream(self, ids: np.ndarray, chunk: int = 1 << 16) -> Iterator[str]:
        machine = Utf8()
        for at in range(0, len(ids), chunk):
            yield machine.feed(self.decode_bytes(ids[at : at + chunk].tolist()))
        yield machine.end()


@cache
def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Made once a worker and vocabulary."""
    gc.set_threshold(200_000, 100, 1000)  # the tables are large and hold no cycles
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``ids``: the token ids of each whole text as little-endian 32-bit integers, in one binary.

    ``path`` is a file of base64 tokens and ranks that every worker can read,
    ``pattern`` splits a text into pieces. Null text is empty; an empty text has
    no ids. Strings that look like special tokens are ordinary text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = codec(path, pattern)
        for batch in slices(batches):
            ids = [encoder(t) if t else b"" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.binary())], [*batch.schema.names[1:], "ids"])

    return _mapped(docs, text, keep or ["doc_id"], work, "ids binary")


def decode_ids(rows: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``text``, decoded as a stream; null ids give a null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else "".join(decoder.stream(np.frombuffer(x, "<u4"))) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    return _mapped(rows, ids, keep or ["doc_id"], work, "text string")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass over the rows.

    A null text is empty: no tokens, and the digests of nothing. Each row stands
    for itself, whether its id is null or repeated; other columns are ignored.
    An empty table gives no rows. A very long text is split whole; a piece of any
    length needs no more memory than the tables' bounds and its ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path, pattern)
        for batch in slices(batches):
            counts, id_sums, text_sums = [], [], []
            for t in batch.column(0).to_pylist():
                ids, back = encoder(t) if t else b"", hashlib.sha256()
                for said in decoder.stream(np.frombuffer(ids, "<u4")):
                    back.update(said.encode())
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(text).alias("t"), F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(tidy(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(df: DataFrame, first: str, keep: list[str], work, more: str) -> DataFrame:
    rows = df.select(F.col(first).alias("__first"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(tidy(work), f"{kinds}, {more}")
