"""Cutting texts at spaces into chunks that the GPT-2 pattern never joins.

Every match of public_tokenizers.PATTERN starts at or after a space that stands alone, so encoding the
chunks " word" one by one and joining the results equals encoding the text. Only where a space has
white space on both sides (or ends the text after white space) does the pattern look across it;
such texts are cut by the pattern itself.
"""

from __future__ import annotations

import re

import public_tokenizers
import regex

PIECES = regex.compile(public_tokenizers.PATTERN)
#: A space inside a longer run of white space; all of Python's \s, which includes the pattern's.
_ACROSS = re.compile(r"\s \s|\s $")


class Memo(dict):
    """Chunk -> encoding. When it holds `limit` entries the older half goes, but what is used comes back
    from it first; long chunks are never kept."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit // 2, {}

    def __missing__(self, chunk: str):
        out = self.older.get(chunk)
        if out is None:
            out = self.encode(chunk)
            if len(chunk) > 48:
                return out
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out


class Chunker:
    """Encodes texts by chunks.

    encode(piece) gives the encoding of one match of the pattern, or, with many=True, of any text.
    """

    def __init__(self, encode, empty, limit: int = 400_000, many: bool = False):
        self.encode, self.empty, self.many = encode, empty, many
        self.pieces = Memo(encode, limit // 8)
        self.first = Memo(self._text, limit // 8)
        self.rest = Memo(self._chunk, limit)

    def _text(self, text: str):
        return self.encode(text) if self.many else self.empty.join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def _chunk(self, chunk: str):
        """Of " " + chunk. A word of letters is one piece, and ASCII punctuation after it another."""
        if self.many or chunk.isalpha():
            return self.encode(" " + chunk)
        if chunk[-1:] in (",", ".", "!", "?", ":", ";") and chunk[:-1].isalpha():
            return self.empty.join((self.rest[chunk[:-1]], self.pieces[chunk[-1]]))
        return self._text(" " + chunk)

    def __call__(self, text: str):
        if not text:
            return self.empty[:0]
        if "  " in text or _ACROSS.search(text):
            return self._text(text)
        head, *tail = text.split(" ")
        parts = [*map(self.rest.__getitem__, tail)]
        if head:
            parts.insert(0, self.first[head])
        return self.empty.join(parts)
