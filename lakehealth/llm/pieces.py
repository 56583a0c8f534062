"""Encoding of whole texts through caches of their pieces.

The split pattern of byte-level vocabularies (``public_tokenizers.PATTERN``) always cuts before a space
that stands between two other characters, so the pieces of ``text.split(" ")``, each but the first with
its space, can be encoded one by one. A space beside other white space need not be a cut: a
piece that is empty or starts with white space makes its text take the slow way.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from itertools import islice

import public_tokenizers
import regex

#: Entries of each of a worker's two caches, unless the caller says otherwise. When one is full, its
#: older half stays: what is met first is frequent.
CACHE_ENTRIES = 400_000
#: Longer pieces are not kept.
LONGEST = 64
#: Letters below it are letters in all versions of Unicode.
PLAIN = "ɐ"
#: Characters that are neither letter, number nor white space: a run of them at the end of a word is a match.
MARKS = string.punctuation


def trim(cache: dict) -> None:
    kept = dict(islice(cache.items(), len(cache) // 2))
    cache.clear()
    cache.update(kept)


class Pieces(dict):
    """piece -> ids as little-endian 32-bit bytes; None if its start is no sure cut. ``lead`` stands before each."""

    def __init__(self, owner: PieceEncoder, lead: str, most: int, first: Pieces | None = None):
        super().__init__()
        self.match_ids, self.other, self.mark = owner.match_ids, owner.other, owner.match
        self.lead, self.most = lead, most
        self.first = self if first is None else first  # the pieces that nothing stands before

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.most:
            trim(self)
        if not piece or piece[0].isspace():
            value = None
        elif "\n" in piece:
            return self.lines(piece)  # mostly met once: kept by its parts
        elif not (piece.isascii() or max(piece) < PLAIN):
            value = self.other(self.lead + piece, True)
        elif piece.isalpha():
            value = self.match_ids(self.lead + piece)  # one match, kept here alone
        else:
            word = piece.rstrip(MARKS)
            if word.isalpha() and len(word) < len(piece):
                value = self[word] + self.mark(piece[len(word):])
            else:
                value = self.other(self.lead + piece, False)
        if len(piece) <= LONGEST:
            self[piece] = value
        return value

    def lines(self, piece: str) -> bytes:
        """A line feed between two characters that are no white space is a match, and so a sure cut on both sides."""
        parts = piece.split("\n")
        if not all(parts) or any(p[0].isspace() or p[-1].isspace() for p in parts):
            return self.other(self.lead + piece, not (piece.isascii() or max(piece) < PLAIN))
        out = [self[parts[0]]]
        for part in parts[1:]:
            out += [self.mark("\n"), self.first[part]]
        return b"".join(out)


class PieceEncoder:
    """``match_ids`` encodes one match of the pattern, ``text_ids`` any text, the slow way."""

    def __init__(self, match_ids: Callable[[str], bytes], text_ids: Callable[[str], bytes],
                 pattern: str = public_tokenizers.PATTERN, most: int = CACHE_ENTRIES):
        self.match_ids, self.text_ids, self.most = match_ids, text_ids, most
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # matches that are no whole piece
        self.first = Pieces(self, "", most)
        self.inner = Pieces(self, " ", most, self.first)

    def match(self, match: str) -> bytes:
        ids = self.known.get(match)
        if ids is None:
            ids = self.match_ids(match)
            if len(match) <= LONGEST:
                if len(self.known) >= self.most:
                    trim(self.known)
                self.known[match] = ids
        return ids

    def other(self, piece: str, rare: bool) -> bytes:
        """A piece of several matches, or with letters that not every version of Unicode has."""
        return self.text_ids(piece) if rare else b"".join(map(self.match, self.matches(piece)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = text.split(" ")
        parts = [self.first[pieces[0]], *map(self.inner.__getitem__, pieces[1:])]
        return self.text_ids(text) if None in parts else b"".join(parts)
