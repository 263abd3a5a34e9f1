"""Token ids from a public tokenizer, whole texts, inside Spark tasks.

``TextEncoder`` calls the ``tokenizers`` library on pieces of text it has not met before and keeps their ids.  Pieces are cut
before a space that touches a non-space on one side at least: a byte-level pre-tokenizer always cuts there, so ids of pieces,
joined, are the ids of the text.  Texts with white space on both sides of a space go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np

#: Pieces that a Python worker keeps of late, and as many of earlier use (some 200 bytes each); ids don't depend on it.
CACHE_PIECES = 500_000
#: Characters of a text that are encoded at once.
SLICE = 1_000_000
#: Id that ends each document.
END_ID = 0
_INNER_SPACE = re.compile(r"\s \s")
#: A word of letters (no contraction can begin in it), then marks, then a line feed and another word: each a unit of its own.
_UNITS = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]*)(\n?)([^\W\d_]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TextEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, without the end id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # in a document their strings are ordinary text
        self.model = self.library.model
        # a word of letters is one unit of a byte-level pre-tokenizer: it can go to the library's merges at once
        step = self.library.pre_tokenizer
        self.direct = self.library.normalizer is None and isinstance(step, pre_tokenizers.ByteLevel) and step.use_regex
        self.direct = self.direct and not step.add_prefix_space
        self.shown = {}  # byte to the symbol that the pre-tokenizer shows for it
        if self.direct:
            for text in (*map(chr, range(33, 127)), " a", *(chr(x) for x in range(0xC0, 0x250))):
                for units, _ in step.pre_tokenize_str(text):
                    self.shown.update(zip(text.encode(), units, strict=True))
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-tokenizer unit: letters, perhaps after a space, or marks."""
        if word.isascii():
            units = self.shown[32] + word[1:] if word[0] == " " else word
        else:
            try:
                units = "".join(map(self.shown.__getitem__, word.encode()))
            except KeyError:
                return self._whole(word)
        return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            if len(self.units) >= CACHE_PIECES // 8:
                self.units.clear()
            ids = self.units[unit] = self._whole(unit) if unit == "\n" else self._word(unit)
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is not known yet."""
        if not self.direct or not piece:
            return self._whole(piece)
        if piece[piece[0] == " " :].isalpha():
            return self._word(piece)
        m = _UNITS.fullmatch(piece)
        if m is None or not (m[1] + m[4]).lstrip(" ").isalpha():
            return self._whole(piece)
        word = m[1][1:] if m[1][0] == " " else None
        return (self._unit(m[1]) if word is None else self._after_space(word)) + b"".join(self._unit(x) for x in m.groups()[1:] if x)

    def _after_space(self, word: str) -> bytes:
        """Ids of a space and a word, from what is known or anew."""
        ids = self.fresh.get(word)
        if ids is None:
            ids = self.aged.get(word)
            if ids is None:
                ids = self._piece(" " + word)
            if len(self.fresh) >= CACHE_PIECES:
                self.fresh, self.aged = {}, self.fresh
            self.fresh[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if _INNER_SPACE.search(text):
            return self._whole(text)
        head, *rest = text.split(" ")
        known, learn = self.fresh.get, self._after_space
        return self._piece(head) + b"".join([known(w) or learn(w) for w in rest])


def _of_kind(kind: str) -> str:
    """Characters below U+0300 of a Unicode category, for a set of a pattern.  Such characters never compose with each other."""
    return "".join(re.escape(c) for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == kind)


_SPACES = "\t-\r \x85\xa0"
#: The units that a word-level pre-tokenizer finds in lower case.
_WORD_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('L')}]+|[{_of_kind('N')}]|[^{_SPACES}{_of_kind('L')}{_of_kind('N')}]+")
#: Characters below U+0300 with a lower case below it.
_SIMPLE = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x300)) if max(c.lower()) < "\u0300") + "]*")


def byte_symbols() -> list[str]:
    """The symbol that a byte-level pre-tokenizer shows for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [shown[b] for b in range(256)]


class Units(dict):
    """Ids of units of a word-level pre-tokenizer; ``tokenize`` gives those of a unit that isn't known.  ``forget`` bounds it."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.aged, self.shown = tokenize, {}, byte_symbols()

    def __missing__(self, unit: str) -> bytes:
        ids = self.aged.get(unit)
        if ids is None:
            symbols = unit if unit.isascii() and unit.isprintable() else "".join([self.shown[b] for b in unit.encode()])
            ids = array("I", [t.id for t in self.tokenize(symbols)]).tobytes()
        self[unit] = ids
        return ids

    def forget(self) -> None:
        if len(self) >= CACHE_PIECES:
            self.aged = dict(self)
            self.clear()


class WordEncoder:
    """Texts to ids, as ``TextEncoder``, for a tokenizer that drops white space.

    Simple characters are cut into the pre-tokenizer's units here, units met before are looked up, and the library's merges are asked
    for the others.  What stands between white space and has another character goes to the library as it is.  The short way is only
    taken if it gives the library's ids for a set of probes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.units = Units(self.library.model.tokenize)
        probes = [a + b + c for a in ("", "Ab", "don") for b in (*map(chr, range(0x300)), "'LL", "'t", "''re") for c in ("", "x1")]
        probes = [x for x in probes if _SIMPLE.fullmatch(x)]
        try:
            self.direct = [self._simple(x) for x in probes] == self._whole(probes)
        except Exception:  # the model has no such unit
            self.direct = False

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, _WORD_UNITS.findall(text.lower())))

    def _some(self, text: str) -> bytes:
        if not self.direct:
            return self._whole([text])[0]
        self.units.forget()
        if text.isascii() or _SIMPLE.fullmatch(text):
            return self._simple(text)
        out = []
        for simple, pieces in groupby(text.replace("\n", " ").replace("\t", " ").split(" "), lambda x: _SIMPLE.fullmatch(x) is not None):
            out += [self._simple(" ".join(pieces))] if simple else self._whole(list(pieces))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        text, out, at = text or "", [], 0
        while (cut := text.find(" ", at + SLICE)) >= 0:  # memory doesn't follow the longest text
            out.append(self._some(text[at:cut]))
            at = cut
        return b"".join([*out, self._some(text[at:])])


_ENCODERS: dict[str, TextEncoder | WordEncoder] = {}


def encoder(path: str) -> TextEncoder | WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        ids = Tokenizer.from_file(path).encode("a \n\t a", add_special_tokens=False).ids
        _ENCODERS[path] = WordEncoder(path) if len(ids) == 2 and ids[0] == ids[1] else TextEncoder(path)
    return _ENCODERS[path]


def slices(texts: list[str | None], characters: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about that many characters, so that memory follows the longest text and not the batch."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= characters:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
