"""Token ids of whole texts, with each distinct piece of text encoded once.

A tokenizers file splits a text into pieces and encodes each by itself, so a worker remembers the ids of pieces. The split
is made here only for texts whose characters all lie below U+0250, where `regex` and the tokenizers library hold the same
view of letters, digits and spaces, and which name no special token; any other text goes to the library whole. Every id
comes from the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: The first character beyond those whose split is made here.
BEYOND = 0x250
#: Pieces remembered by a worker; beyond it the memory starts anew.
MOST_PIECES = 800_000
#: New pieces that are encoded as one text.
PIECES_AT_ONCE = 2000
#: Characters of text that are split before their new pieces are encoded together.
CHARS_AT_ONCE = 2_000_000


def chars(kind: str) -> str:
    """The characters below BEYOND that `regex` holds to be of a kind, as the inside of a character class."""
    return "".join(f"\\u{c:04x}" for c in range(BEYOND) if regex.match(kind, chr(c)))


LETTER, NUMBER, SPACE = chars(r"\p{L}"), chars(r"\p{N}"), chars(r"\s")
PLAIN = re.compile(f"[\\u0000-\\u{BEYOND - 1:04x}]*")
#: How the two public vocabularies split a text, over plain characters: contractions, letters, numbers, others, spaces.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(f"{CONTRACTIONS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_LEVEL = re.compile(f"{CONTRACTIONS}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """texts → the ids of each, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, special: bool = True, most: int = MOST_PIECES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a core for each task
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = not special  # the library's name for: take their strings as plain text
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.pieces: dict[str, bytes] = {}
        self.most = most
        normal, splits = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        self.find, self.lower, self.bare = None, False, None
        if self.tokenizer.normalizer is None and splits.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in splits:
            self.find = BYTE_LEVEL.findall
            self.bare = Tokenizer.from_file(vocabulary(name))
            self.bare.encode_special_tokens = True  # lines are pieces, in which a special token's string has been seen to
            self.bare.pre_tokenizer = pre_tokenizers.Split("\u010a", "isolated")
            self.last, self.feed = self.marked(lambda t: t == "\u010a"), 1
        elif "NFC()" in normal and "Lowercase()" in normal and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in splits:
            self.find, self.lower = WORD_LEVEL.findall, True
            self.last, self.feed = self.marked(lambda t: t.endswith("</w>")), 0

    def marked(self, end: Callable[[str], bool]) -> np.ndarray:
        """For each id whether it ends a line: the line feed itself, or a word's last token."""
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        out[[i for t, i in self.tokenizer.get_vocab().items() if end(t)]] = True
        return out

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, encoded many at a time, as lines of one text: taking each one's ids from the library
        costs as much as the encoding. Pieces of a byte-level vocabulary are spelt in its characters here, so that the library
        splits at line feeds only. A line's ids end where a line feed's id stands, or where the vocabulary marks a
        word's end; should their number be another than that of the pieces, each piece is encoded by itself. Pieces of
        white space are too; in all others white space can only be one space at the start."""
        known, cut = self.pieces, self.feed
        blank = [p for p in pieces if p.isspace()]
        if blank:
            known.update(zip(blank, self.encode(blank), strict=True))
            pieces = [p for p in pieces if not p.isspace()]
        runs = [pieces[k : k + PIECES_AT_ONCE] for k in range(0, len(pieces), PIECES_AT_ONCE)]
        lines = ["\n".join([*some, ""]) for some in runs]
        lines = (self.bare or self.tokenizer).encode_batch_fast([spelt(x) for x in lines] if self.bare else lines, add_special_tokens=False)
        for some, line in zip(runs, lines, strict=True):
            ids = np.array(line.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or len(ids) != ends[-1]:
                known.update(zip(some, self.encode(some), strict=True))
                continue
            data, ends = ids.tobytes(), 4 * ends
            starts = [0, *ends[:-1].tolist()]
            known.update(zip(some, map(data.__getitem__, map(slice, starts, (ends - 4 * cut).tolist())), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        return self.find is not None and PLAIN.fullmatch(text) is not None and "\u0130" not in text and not any(s in text for s in self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.most:
            self.pieces.clear()
        split = [self.find(t.lower() if self.lower else t) if self.plain(t) else None for t in texts]
        if len(self.pieces) > self.most:
            self.pieces.clear()
        known, new = self.pieces, set()
        for pieces in split:
            if pieces is not None:
                new.update(pieces)
        self.learn(list(new.difference(known)))  # not `new - known.keys()`, which goes through all that is known
        whole = iter(self.encode([t for t, pieces in zip(texts, split, strict=True) if pieces is None]))
        return [next(whole) if pieces is None else b"".join(map(known.__getitem__, pieces)) for pieces in split]


#: How a byte-level vocabulary writes the bytes that aren't printable characters of their own: in order, from U+0100 on.
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = [(chr(b), chr(0x100 + k)) for k, b in enumerate(b for b in range(256) if b not in SHOWN)]


def spelt(lines: str) -> str:
    """Lines in the characters of a byte-level vocabulary, line feeds too."""
    out = lines.encode().decode("latin-1")
    for byte, char in HIDDEN:
        if byte in out:
            out = out.replace(byte, char)
    return out


@cache
def encoder(name: str, special: bool = True, most: int = MOST_PIECES) -> Encoder:
    """One for each worker process, which later tasks use again: a Tokenizer and its memory don't travel. With special=False
    the strings of special tokens are plain text."""
    return Encoder(name, special, most)


@cache
def token_bytes(name: str) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for. Such a vocabulary writes printable bytes as the characters of
    their number, and the others, in order, as those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}
    known = encoder(name).tokenizer.get_vocab()
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def slices(column: pa.Array, at_once: int) -> Iterator[list[str]]:
    """The texts of an Arrow column, null as empty, in runs of about `at_once` characters."""
    run, size = [], 0
    for text in column:
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size > at_once:
            yield run
            run, size = [], 0
    if run:
        yield run
