"""Whole texts to the ids that the tokenizers library gives, from its own vocabulary files.

The library's byte-level and word BPE are fast only where pieces repeat within
one call. Both are the merging of the pair of lowest rank in each piece of a
text, so the ids follow from the file's vocabulary with any implementation of
that: here tiktoken's, whose ranks are the file's ids (checked: each merge has a
larger id than the one before). Tests hold the ids against the library's.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator
from functools import cache

import regex

#: Pieces in the memo of words before it is emptied; results do not depend on it.
MEMO = 1 << 17
#: Stands for the end of a word. This byte is in no UTF-8 text.
END = b"\xff"
#: Characters below are whole by themselves and lower-cased one by one; words with others are left to the library.
LATIN = "\u0250"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], str]:
    """Ranks by bytes and the suffix that ends words; tokens that end a word end in END."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, to_byte, ranks = model.get("end_of_word_suffix") or "", byte_of(), {}
    for token, number in model["vocab"].items():
        body, end = (token[: -len(suffix)], END) if suffix and token.endswith(suffix) and len(token) > len(suffix) else (token, b"")
        if all(c in to_byte for c in body):
            ranks.setdefault(bytes(to_byte[c] for c in body) + end, number)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(p).replace(suffix, "", 1) if suffix and p[0].endswith(suffix) else "".join(p)] for p in pairs]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return ranks, suffix


class Memo(dict):
    """What a function gave for words of up to 64 bytes; the words met since it was last but one emptied."""

    def __init__(self, of: Callable[[bytes], bytes]):
        super().__init__()
        self.of, self.older = of, {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.of(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


class Encoder:
    """``pattern``: how the vocabulary's own splitting cuts a text into pieces; None for the word vocabulary, whose tokenizer lower-cases and drops blanks."""

    def __init__(self, path: str, pattern: str | None):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks, suffix = read_vocabulary(path)
        if bool(suffix) == bool(pattern):
            raise ValueError("a vocabulary with word ends has its own splitting, any other needs a pattern")
        self.plain = tiktoken.Encoding(path, pat_str=pattern or r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.pattern = pattern
        if suffix:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
            self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
            self.piece = self.plain._core_bpe.encode_single_piece
            self.memo = Memo(self._word)

    def _word(self, word: bytes) -> bytes:
        """The ids of what stands between two ASCII blanks. Only there can the splitting of a text not depend on what is around."""
        text = word.decode()
        if text.isascii() or max(text) < LATIN:
            ids = [i for p in self.pieces(text.lower()) for i in self.piece(p.encode() + END)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; none for a null text."""
        for text in texts:
            if not text:
                yield b""
            elif self.pattern:
                yield self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            else:
                self.memo.trim()
                yield b"".join(map(self.memo.__getitem__, text.encode("utf-8", "replace").split()))


@cache
def encoder(path: str, pattern: str | None) -> Encoder:
    """Made once a worker and vocabulary."""
    return Encoder(path, pattern)
