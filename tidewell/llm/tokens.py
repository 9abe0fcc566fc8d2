"""Token ids of whole texts by the `tokenizers` library, with a cache of pieces (words, mostly).

Both vocabularies cut a text into pieces and merge bytes inside each. Here texts are cut by the vocabulary's own pattern, and a piece not seen before goes to
the library's model. Where a text holds anything for which the pattern's meaning depends on Unicode tables (unusual characters, runs of white space), the whole
text goes to the library instead.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

import numpy as np

from tidewell.llm.common import held

#: Pieces of a generation of the cache (about 40 MB). When one is full the one before goes, so a worker keeps two at most, and what is in use stays.
CACHE = 200_000
#: Characters about whose class all Unicode tables agree: printable ASCII, Latin letters, common punctuation.
_KNOWN = r"\n\x20-\x7e¡-¬®-įı-ſ–—‘’“”…•€"
_ODD = re.compile(f"[^{_KNOWN}]")
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The vocabularies' own patterns for pieces, for known characters without runs of white space.
_BYTE_PIECES = re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ \n{_LETTER}{_NUMBER}]+|\n")
_WORD_PIECES = re.compile(rf"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^ \n{_LETTER}{_NUMBER}]+")


def _byte_names() -> list[str]:
    """The characters by which byte-level vocabularies name bytes: printable Latin-1 ones name themselves, the others U+0100 and on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_NAMES = _byte_names()


class _Pieces(dict):
    """piece -> ids as little-endian 16-bit integers, by the library's merges."""

    def __init__(self, model):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        name = piece.replace(" ", _NAMES[32]).replace("\n", _NAMES[10]) if piece.isascii() else "".join(map(_NAMES.__getitem__, piece.encode()))
        ids = array("H", [t.id for t in self.model.tokenize(name)]).tobytes()
        self[piece] = ids
        return ids


def _has_runs(text: str) -> bool:
    """Is there white space at an end or beside white space?"""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text


class Encoder:
    """encode(text) gives the ids of a text as bytes of '<u2'. The vocabulary must have fewer than 65,536 ids.

    words=True: the vocabulary lower-cases and drops white space (word ends are marked); otherwise it is byte-level and keeps it. added=True: the name of an added
    token inside a text gives that token, as the library does unless told otherwise; otherwise it is ordinary text.
    """

    def __init__(self, path: str, words: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        names = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.named = re.compile("|".join(map(re.escape, names))).search if names else None
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: more than 65,536 ids")
        self.words = words
        if sys.byteorder != "little":
            raise ValueError("ids are little-endian")
        self.pieces, self.cut = _Pieces(self.library.model), (_WORD_PIECES if words else _BYTE_PIECES).findall

    def encode(self, text) -> bytes:
        if not isinstance(text, str) or not text:
            return b""
        if self.named and self.named(text):
            pass
        elif self.words:
            plain = text.replace("\t", " ").replace("\r", " ")
            if not _ODD.search(plain):
                return b"".join(map(self.pieces.__getitem__, self.cut(unicodedata.normalize("NFC", plain).lower())))
        elif not _ODD.search(text) and not _has_runs(text):
            return b"".join(map(self.pieces.__getitem__, self.cut(text)))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def encoder(path: str, words: bool) -> Encoder:
    """The worker's encoder of this vocabulary; names of added tokens give these tokens."""
    return held(("tokens", path, words), lambda: Encoder(path, words, added=True))
