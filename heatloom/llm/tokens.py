"""Token ids of texts by a public tokenizer file, as little-endian 32-bit integers."""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import category

END_ID = 2
WIDTH = 4
# A new pre-token always begins where ordinary blank space follows another
# character, and where ASCII punctuation follows a letter, so texts may be cut
# there before they are encoded. Texts with blank characters beyond these four
# are encoded in one piece. Letters are those that every Unicode version has.
_LETTERS = "A-Za-z" + "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha())
_PART = re.compile(
    rf"[ \n\t\r]*+[^ \n\t\r{_LETTERS}]*+[{_LETTERS}]++(?=[\n\t\r -/:-@\[-`{{-~]|\Z)|[ \n\t\r]*+[^ \n\t\r]++|[ \n\t\r]++"
)
_WORD = re.compile(rf" ?[{_LETTERS}]+")
_OTHER_BLANK = re.compile(
    "[" + "".join(re.escape(c) for c in map(chr, range(0x10000)) if (c.isspace() or category(c) in ("Zs", "Cf")) and c not in " \n\t\r") + "]"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Encodes texts part by part and remembers short parts in two generations of ``room`` each."""

    def __init__(self, path: str, room: int = 400_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # parts that come again never reach the model
        self.room, self.longest, self.older = room, longest, {}
        self.as_model = {}
        for letter in map(chr, [32, *range(0x180)]):
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(letter)
            self.as_model[ord(letter)] = "".join(x[0] for x in found)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, part: str) -> bytes:
        if len(part) > self.longest:
            return self._encode(part)
        ids = self.older.get(part)
        if ids is None:
            if _WORD.fullmatch(part):
                # One pre-token: only the model is left to run.
                ids = array("I", [x.id for x in self.model.tokenize(part.translate(self.as_model))]).tobytes()
            else:
                ids = self._encode(part)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids of a whole text, without an end id; null is empty."""
        if not text:
            return b""
        # The blanks as a lone character class: beside other patterns its search takes three times as long.
        if any(x in text for x in self.special) or _OTHER_BLANK.search(text):
            return self._encode(text)
        return b"".join(map(self.__getitem__, _PART.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
