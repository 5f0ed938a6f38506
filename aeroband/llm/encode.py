"""Whole texts to token ids with a public tokenizer, as little-endian bytes.

Invented or rare words dominate the cost of merges, so each worker keeps the ids of pieces
of text it has seen.  A text is cut only where the tokenizer itself always cuts, whatever
stands around: before a single space between two characters that are not white space, and
around a single line feed between such characters.  A text with any other white space is
cut by a slower search for the same places.  A piece of Latin letters, with one stop at
most, goes straight to the tokenizer's merges.  Ids therefore equal those of the whole text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from operator import attrgetter

import numpy as np

#: Pieces kept in each of two generations; the older one goes when the younger is full.
KEPT = 250_000
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Characters that str.split() takes for white space and the tokenizers' patterns do not.
_UNCLEAR = "\x1c\x1d\x1e\x1f\x85"
#: White space besides the space and the line feed, in ASCII and beyond.
_BLANKS = "\t\r\x0b\x0c"
_WIDE_BLANKS = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Letters that NFC leaves alone and whose lower case is letters; a stop after them stands alone.
_LATIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f]+)([,.!?]?)")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the others numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()
_ID = attrgetter("id")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under one vocabulary file.  ``joins``: whether a space belongs to the next piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        #: Strings that are tokens of their own wherever they stand; a text with one is encoded whole.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        sample = [self._ids(x) for x in ("a b", "a", " b", "b")]
        self.joins = sample[0] != sample[1] + sample[3]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: Only where the merges alone give the ids of words, as in byte-level vocabularies.
        self.straight = sys.byteorder == "little" and all(
            self._merged(" ", x[1:]) == self._bytes(self._ids(x)) for x in (" word", " Größe", " thntner", " ÉLLEANT"))
        self.lowers = self._ids("ABC É") == self._ids("abc é")
        self.stops = {x: self._bytes(self._ids(x)) for x in ",.!?"}

    def _ids(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        if any(x in text for x in _UNCLEAR):
            return [text]
        if not self.joins:
            try:
                text.encode("latin-1")  # whose lower case is the tokenizer's, letter by letter
            except UnicodeEncodeError:
                return text.split()
            return text.lower().split() if self.lowers else text.split()
        if any(x in text for x in _BLANKS) or "  " in text or (not text.isascii() and any(x in text for x in _WIDE_BLANKS)):
            return _SAFE.split(text)
        for k, line in enumerate(text.split("\n")):
            if not line or line[0] == " " or line[-1] == " ":
                return _SAFE.split(text)
            words = line.split(" ")
            if k:
                out.append("\n")
            out.append(words[0])
            out += [" " + w for w in words[1:]]
        return out

    def _merged(self, space: str, stem: str) -> bytes:
        """Ids of a run of Latin letters, with the space before it where that belongs to it."""
        if not self.joins:
            stem, space = stem.lower(), ""
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(_LETTERS)
        return array(self.code, map(_ID, self.merge(("\u0120" if space else "") + stem))).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        old, young, others = self.old, self.young, []
        for p in pieces:
            known = old.get(p)
            if known is not None:
                young[p] = known
                continue
            found = _LATIN.fullmatch(p) if self.straight else None
            if not found:
                others.append(p)
            elif found[3]:
                stem = p[:-1]
                known = young.get(stem) or old.get(stem)
                if known is None:
                    known = young[stem] = self._merged(found[1], found[2])
                young[p] = known + self.stops[found[3]]
            else:
                young[p] = self._merged(found[1], found[2])
        for k in range(0, len(others), 4096):
            part = others[k:k + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                young[p] = self._bytes(e.ids)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text and the id ``end``; null and empty texts have the end alone."""
        tail, out = self._bytes([end]), []
        for text in texts:
            if text and any(t in text.lower() for t in self.added):
                out.append(self._bytes(self._ids(text)) + tail)
                continue
            pieces = self.pieces(text) if text else []
            ids = list(map(self.young.get, pieces))
            if None in ids:
                missing = {p for p, x in zip(pieces, ids) if x is None}
                if len(self.young) + len(missing) > KEPT:
                    self.old, self.young = self.young, {}
                self._learn(missing)
                ids = [self.young[p] if x is None else x for p, x in zip(pieces, ids)]
            ids.append(tail)
            out.append(b"".join(ids))
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
