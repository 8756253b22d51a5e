"""Texts as space-led units that a byte-level or a piece tokenizer encodes each by itself.

Where a space follows anything but white space, every token ends: byte-level models split there before
they merge, and no piece of the sentence-piece vocabulary holds a mark of a space after anything else. So
a text's tokens are those of its units one after another, and a unit needs encoding only once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

#: Units that a Python worker remembers at most, and the longest of them in characters.
KNOWN_UNITS, LONGEST = 400_000, 48

_AFTER_WHITE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: One pre-token of letters, and one of the marks after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

#: Byte-level models write a byte as the character of its number, where that is printable.
BYTE_LETTERS = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
BYTE_LETTERS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in BYTE_LETTERS)}
LETTER_BYTES = {c: b for b, c in BYTE_LETTERS.items()}


def letters_of(data: bytes) -> str:
    return data.decode("latin-1").translate(BYTE_LETTERS)


def bytes_of(letters: str) -> bytes:
    return bytes(map(LETTER_BYTES.__getitem__, letters))


def units(text: str) -> list[str]:
    """The text cut at each space that follows anything but white space, without those spaces. The
    first unit has no space before it, each other one has."""
    return _CUT.split(text) if text.startswith(" ") or _AFTER_WHITE.search(text) else text.split(" ")


class Remembered[T]:
    """What `encode` gives for strings, of which the short ones are remembered: those met since the last
    turn, and those of the turn before, which were met between its beginning and its end."""

    def __init__(self, encode: Callable[[list[str]], Iterable[T]], most: int = KNOWN_UNITS):
        self.encode, self.most, self.known, self.before = encode, most, {}, {}

    def __call__(self, words: set[str]) -> dict[str, T]:
        """What is known, all of words included; valid until the next call."""
        if len(self.known) > self.most // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = words.difference(known)
        again = new.intersection(before)
        known.update(zip(again, map(before.__getitem__, again), strict=True))
        new = [*new.difference(again)]
        known.update(zip(new, self.encode(new), strict=True))
        if any(len(w) > LONGEST for w in new):
            self.known = {w: x for w, x in known.items() if len(w) <= LONGEST}
        return known


def byte_level(tokenizer, lead: str = " ") -> Callable[[list[str]], list[list[int]]]:
    """An encoder of strings, with lead before each, by a byte-level model of the tokenizers library.

    Letters with marks after them are two pre-tokens at most, which the model takes as they are; that
    spares the library's pipeline for each. The pipeline takes all others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model, first = tokenizer.model, letters_of(lead.encode())
    marks_known: dict[str, list[int]] = {}

    def encode(words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for w in words:
            found = _PLAIN.fullmatch(w) if len(w) <= LONGEST else None
            if found is None:
                out.append(None)
                continue
            base, marks = found.groups()
            ids = [x.id for x in model.tokenize(first + (base if base.isascii() else letters_of(base.encode())))]
            if marks:
                if (more := marks_known.get(marks)) is None:
                    more = marks_known[marks] = [x.id for x in model.tokenize(marks)]
                ids += more
            out.append(ids)
        if len(marks_known) > 10_000:
            marks_known.clear()
        rest = [lead + w for w, x in zip(words, out, strict=True) if x is None]
        others = iter(tokenizer.encode_batch(rest, add_special_tokens=False)) if rest else iter(())
        return [next(others).ids if x is None else x for x in out]

    return encode
