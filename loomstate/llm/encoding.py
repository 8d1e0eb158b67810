"""Token ids of whole texts by the tokenizers library, piece by piece where that is exactly the same.

Both vocabularies split a text by a pattern before they merge. A text whose characters are all below U+0250, where no normal
form changes anything and letters, numbers and white space are few ranges, is split here by the same pattern, and each
distinct piece goes through the library's merges once for each worker and is then a look-up. Any other text is cut where
the pattern cuts whatever stands there: at white space for the word vocabulary; for the byte-level one before a single space
between two other characters and around a single newline between two; what is between the cuts is encoded by the library. The
caches are bounded by their number of entries.

The library finds the vocabulary's added tokens in a text before it splits it, wherever they stand; a text with the marks
that these begin with goes to the library whole. `added=False` takes their strings for ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

KEPT_PIECES, KEPT_LENGTH = 250_000, 80
#: A piece of more characters goes to the library as a text.
LONG_PIECE = 1000
#: Python takes these for white space, Unicode doesn't.
ODD = re.compile("[\x1c-\x1f]")
#: A cut where a single space, with a character before and after it, begins a piece.
CUT = re.compile(r"(?<=\S)(?= \S)")


#: Below U+0250: letters, numbers and white space, as the patterns' classes have them.
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BEYOND = re.compile("[^\x00-\u024f]")
#: The splits of the two vocabularies.
WORD_SPLIT = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
BYTE_SPLIT = re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies have for each byte: its own if it prints, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Merged(dict):
    """A piece of the split to its ids, by the library's merges."""

    def __init__(self, library, whole):
        super().__init__()
        self.tokenize, self.whole, self.letters = library.model.tokenize, whole, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            return self.whole(piece)
        if piece.isascii() and piece.isprintable() and " " not in piece[1:]:
            letters = piece if piece[0] != " " else self.letters[32] + piece[1:]
        else:
            letters = "".join([self.letters[b] for b in piece.encode()])
        found = array("I", [x.id for x in self.tokenize(letters)]).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


class Uneven(Exception):
    """A part that has white space at an end, so that its cut isn't one of the library's."""


class Pieces(dict):
    """Piece to its ids as little-endian 32-bit bytes; a missing one is encoded by the library."""

    def __init__(self, encode, lead: str = "", whole: bool = False):
        super().__init__()
        self.encode, self.lead, self.whole = encode, lead, whole

    def __missing__(self, piece: str) -> bytes:
        if not self.whole and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise Uneven
        found = self.encode(self.lead + piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


def begins(token: str) -> str:
    """The marks that an added token begins with; empty if it begins with a letter, a number or white space."""
    return token[: next((k for k, c in enumerate(token) if c.isalnum() or c.isspace() or c > "~"), len(token))]


class Encoder:
    """Ids of a text as bytes. spaces: whether the vocabulary sees white space. added: whether added tokens count as the library has them."""

    def __init__(self, path: str, spaces: bool, added: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.spaces = Tokenizer.from_file(path), spaces
        self.library.encode_special_tokens = not added
        self.marks = {begins(t.content) for t in self.library.get_added_tokens_decoder().values()} if added else set()
        self.merged, self.split = Merged(self.library, self.whole), (BYTE_SPLIT if spaces else WORD_SPLIT).findall
        self.first, self.later, self.parts = Pieces(self.part), Pieces(self.part, " "), Pieces(self.whole, whole=True)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def part(self, text: str) -> bytes:
        """A part without white space inside, but for a space before it."""
        if (text.isascii() or max(text) < "\u0250") and len(text) <= KEPT_LENGTH and not ODD.search(text) and (inside := text.strip(" ")).split() == [inside]:
            return b"".join(map(self.merged.__getitem__, self.split(text if self.spaces else text.lower())))
        return self.whole(text)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(mark in text for mark in self.marks):
            return self.whole(text)
        if text.isascii() or not BEYOND.search(text):
            return b"".join(map(self.merged.__getitem__, self.split(text if self.spaces else text.lower())))
        if not self.spaces:
            if ODD.search(text):
                return self.whole(text)
            return b"".join(map(self.first.__getitem__, text.split()))
        try:
            found, newline = [], self.parts["\n"]
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                found.append(self.first[head])
                found += map(self.later.__getitem__, rest)
                found.append(newline)
            found.pop()
            return b"".join(found)
        except Uneven:
            return b"".join(map(self.parts.__getitem__, CUT.split(text)))


@lru_cache(maxsize=4)
def encoder(path: str, spaces: bool) -> Encoder:
    """One for each worker process."""
    return Encoder(path, spaces)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
