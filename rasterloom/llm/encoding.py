"""Token ids of whole texts, by a tokenizer file of the ``tokenizers`` library.

The library's own BPE is slow on long texts and keeps few words in its cache. Where a
file's pre-tokenizer provably cuts at certain white space, a text is cut there, each
distinct piece is encoded once by the library and its ids are kept; other texts (and
other files) are encoded whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from operator import itemgetter
from unicodedata import is_normalized, normalize

from tokenizers import Tokenizer

#: White space other than spaces and line ends.
_OTHER = re.compile(r"[^\S \n]")


def _ragged(text: str) -> bool:
    """A space lies beside other white space: the byte-level pattern looks ahead there."""
    return "  " in text or " \n" in text or "\n " in text or bool(_OTHER.search(text))


#: White space to Python that the library's patterns take as ordinary characters.
_CONTROL = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class _Kept(dict):
    """Ids of pieces, in two generations: what is asked for again stays."""

    def __init__(self, encode, model, lower: bool, most: int):
        super().__init__()
        self.encode, self.model, self.lower, self.most = encode, model, lower, most
        self.letters = dict(enumerate(byte_letters()))
        self.space = self.letters[32]
        self.old: dict[str, bytes] = {}
        self.marks = {m: encode(m) for m in ".,!?:;"}
        self.line_end = encode("\n")

    def __missing__(self, piece: str) -> bytes:
        # one closing mark after a letter is a piece of its own, and so is the word before it
        if (mark := self.marks.get(piece[-1:])) is not None and self._ends_in_letter(piece[:-1]):
            return self[piece[:-1]] + mark
        ids = self.old.get(piece)
        if ids is None:
            ids = self._made(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _ends_in_letter(self, word: str) -> bool:
        """So the pattern sees it: lower-casing and NFC may leave a combining mark last, which joins a mark after it."""
        last = word[-1:]
        return last.isalpha() and (not self.lower or last.isascii() or normalize("NFC", last.lower())[-1].isalpha())

    def _made(self, piece: str) -> bytes:
        word = piece[1:] if (bare := piece[:1] == CLOSING) else piece
        if word.isalpha():
            # letters only: one piece to every pre-tokenizer here, so the model alone decides
            if not self.lower:
                return self._model(word if bare else " " + word)
            low = word.lower()
            if low != word and word.isascii():
                return self[low]
            if low == word and (word.isascii() or is_normalized("NFC", word)):
                return self._model(word)
        elif word[:1] == "\n" and word[1:2].isalpha() and not bare and not self.lower:
            return self.line_end + self[CLOSING + word[1:]]
        if bare or self.lower or word[:1] == "\n":
            return self.encode(word)
        return self.encode(" " + word)

    def _model(self, word: str) -> bytes:
        shown = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


#: Marks a piece that no space comes before.
CLOSING = "\0"


class PieceEncoder:
    """Encode texts to little-endian unsigned 32-bit ids.

    ``path`` is a tokenizer file; ``cache_pieces`` bounds the kept pieces (older ones
    are dropped beyond it, which costs time only).
    """

    def __init__(self, path: str, cache_pieces: int = 700_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if spec["model"]["type"] == "BPE" and self._adds_nothing():
            if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True):
                self.kind = "spaced"
            elif self._drops_space(spec):
                self.kind = "words"
        # the byte-level pattern takes all but the last line end of a run as one piece, and all of a run that nothing follows
        self.runs = ("\n\n\n", *("\n\n" + t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.kept = _Kept(self._whole, self.tokenizer.model, self.kind == "words", max(1, cache_pieces // 2))

    def _adds_nothing(self) -> bool:
        return not self.tokenizer.encode("", add_special_tokens=False).ids

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """White space is removed between pieces, and no normalizer joins across it."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
            return False
        return parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        if CLOSING in text:
            return None
        if self.kind == "words":
            return None if _CONTROL.search(text) else text.split()
        if self.kind == "spaced" and not _ragged(text) and not text.endswith("\n\n") and not any(x in text for x in self.runs):
            # a space or line end between two solid characters always begins a new piece
            first, *rest = text.replace("\n", " \n").split(" ")
            return [CLOSING + first, *rest] if first else rest
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[bytes] = []
        kept = self.kept
        for text in texts:
            pieces = self._pieces(text)
            if pieces is None:
                out.append(self._whole(text))
            elif len(pieces) > 1:
                out.append(b"".join(itemgetter(*pieces)(kept)))
            else:
                out.append(kept[pieces[0]] if pieces else b"")
        return out


@cache
def encoder_for(path: str) -> PieceEncoder:
    """One encoder a process: Python workers outlive tasks, and so do the kept pieces."""
    return PieceEncoder(path)
