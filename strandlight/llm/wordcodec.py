"""Encode whole texts through a memo of their words.

A text is cut only where the tokenizer's own pre-tokeniser must cut too, so that the ids of the
pieces, put in a row, are the ids of the text:

* before a space or line feed that follows a character that is not white space;
* before ``.`` or ``,`` that follows a Latin letter or a digit.

Texts whose shape the fast cuts do not cover take slower but equally exact ones.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LATIN = "A-Za-z0-9À-ÖØ-öø-ɏ"
_NOT_FAST = re.compile(rf"[ \n.,](?:(?<=\s[ \n])|(?<=[^{LATIN}][.,]))")
_BAD_STOP = re.compile(rf"[.,](?<=[^{LATIN}][.,])")
_CUT = re.compile(r"(?=[ \n])(?<=\S)")
# an ASCII piece's parts, as the two vocabularies' own patterns part ASCII
_PARTS_SPACED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\r0-9A-Za-z]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_PARTS_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\r0-9a-z]+")
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
MEMO_BYTES = 192 << 20  # of a worker's memo, its overhead included
ENTRY_BYTES = 180  # what a memo's entry takes beside its text and ids


def _byte_letters() -> str:
    """The printable stand-in of each byte in byte-level vocabularies, by byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


BYTE_LETTERS = _byte_letters()


def shown(piece: str) -> str:
    """The piece's UTF-8 as byte-level vocabularies write it."""
    return codecs.charmap_decode(piece.encode(), "strict", BYTE_LETTERS)[0]


def cut_spaced(text: str) -> list[str]:
    """Pieces that keep their leading white space; joined they are the text."""
    if "\0" in text or _NOT_FAST.search(text):
        return [x for x in _CUT.split(text) if x]
    return text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")


def cut_plain(text: str) -> list[str]:
    """Pieces without white space, for vocabularies that drop it and lower-case."""
    if "<|" in text or "Σ" in text:
        return text.replace("\n", " ").split(" ")
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower().replace("\n", " ")
    if _BAD_STOP.search(text):
        return text.split(" ")
    return text.replace(",", " ,").replace(".", " .").split(" ")


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class _Memo(dict):
    """piece -> its ids; what is missing is encoded and kept."""

    __slots__ = ("held", "word")

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.word(piece)
        self.held += len(piece) + len(ids) + ENTRY_BYTES
        return ids


class WordCodec:
    """One tokenizer file and a memo of bounded bytes: piece -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, max_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec["pre_tokenizer"]
        self.spaced = kind["type"] == "ByteLevel"
        suffix = model["end_of_word_suffix"]
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        # without its cache the model is several times faster on words that are each seen once; the tokenizer shares it
        self.tokenizer.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **({"end_of_word_suffix": suffix} if suffix else {}))
        self.model = self.tokenizer.model
        self.cut = cut_spaced if self.spaced else cut_plain
        self.parts = (_PARTS_SPACED if self.spaced else _PARTS_PLAIN).findall
        self.max_bytes, self.memo = max_bytes, _Memo()
        self.memo.held, self.memo.word = 0, self.word

    def word(self, piece: str) -> bytes:
        bare = piece[1:] if self.spaced and piece[:1] == " " else piece
        lower = self.spaced or bare.islower()
        if bare.isascii():
            if bare.isalpha() and lower:
                found = self.model.tokenize("Ġ" + bare if bare is not piece else bare)
            elif "<|" in bare or "\0" in bare:
                return self._whole(piece)
            else:
                found = []
                for part in self.parts(piece if self.spaced else piece.lower()):
                    found += self.model.tokenize(shown(part))
        elif lower and _LATIN_WORD.fullmatch(bare) and (self.spaced or unicodedata.is_normalized("NFC", bare)):
            found = self.model.tokenize(shown(piece))
        else:
            return self._whole(piece)
        return _little(array("I", [t.id for t in found]))

    def _whole(self, piece: str) -> bytes:
        return _little(array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids))

    def encode(self, text: str) -> bytes:
        """The text's ids, 32 bits each, little-endian."""
        memo = self.memo
        out = b"".join(map(memo.__getitem__, self.cut(text)))
        if memo.held > self.max_bytes:
            memo.clear()
            memo.held = 0
        return out


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """This worker's codec for a file, kept between tasks; only the last file's is."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]
