"""Whole-text encoding with the tokenizers library, sped up by encoding each distinct word once."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Python's white space that the tokenizer's \s might read otherwise: such texts are cut at ASCII white space alone.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ASCII_SPACE = re.compile(r"[ \t\n\r]+")
#: In a very long stretch without white space: between an ASCII letter and an ASCII sign no match or composition crosses.
_SIGN = re.compile(r"(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])")
LONG_WORD = 20_000
#: What the tokenizer's pattern finds in Latin-1 text in lower case, of which composition leaves every character as it is.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_signs() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _latin(text: str) -> bool:
    """Whether the text has Latin-1 characters alone, and none of _ODD."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        if "\x85" in text or "\xa0" in text:
            return False
    return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


def parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of about `size` characters, cut at white space."""
    start = 0
    while len(text) - start > size:
        found = _ASCII_SPACE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def words_of(text: str) -> list[str]:
    """Pieces that the tokenizer encodes one by one as it does in the whole text.

    It drops white space and its pattern never crosses it, and neither composition nor lower case does.
    """
    if _ODD.search(text) is None:
        found = text.split()
    else:
        found = [w for w in _ASCII_SPACE.split(text) if w]
    if len(text) > LONG_WORD and max(map(len, found), default=0) > LONG_WORD:
        found = [p for w in found for p in (_SIGN.split(w) if len(w) > LONG_WORD else (w,)) if p]
    return found


class _Table(dict):
    """key -> ids as bytes; a key that isn't there is looked up among older ones, or made."""

    def __init__(self, make: Callable[[str], list[int]], older: dict[str, bytes] | None = None):
        super().__init__()
        self.make, self.older = make, older or {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = array("I", self.make(key)).tobytes()
        self[key] = ids
        return ids

    def aged(self, most: int) -> _Table:
        """The table, or, beyond `most` keys, a new one that knows this one's as older; long keys are forgotten."""
        return self if len(self) <= most else _Table(self.make, {k: x for k, x in self.items() if len(k) <= 64})


class WordEncoder:
    """Encodes texts by tables of what the tokenizer makes of a piece or word, of which two generations are kept.

    Latin-1 texts are cut into pieces, the runs that the tokenizer's pattern finds in them in lower case, which its model
    encodes; of other texts the words go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        self.tokenizer, self.most, signs = load(path), most, _byte_signs()
        tokenize = self.tokenizer.model.tokenize

        def piece(text: str) -> list[int]:
            return [t.id for t in tokenize(text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(signs))]

        self.pieces = _Table(piece)
        self.words = _Table(lambda word: self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _ids(self, text: str) -> bytes:
        if _latin(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, words_of(text)))

    def encode(self, texts: Iterable[str | None], end_id: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each whole text (null: empty), followed by end_id if one is given."""
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for text in texts:
            yield np.frombuffer(b"".join([*map(self._ids, parts(text or "")), end]), "<u4")
            self.pieces, self.words = self.pieces.aged(self.most), self.words.aged(self.most)
