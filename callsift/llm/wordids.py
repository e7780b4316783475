"""Token ids of whole texts with the public word tokenizer, one distinct word at a time.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words in order.  A worker keeps the ids of the words it has met
(``CACHE`` of them at most, then it starts afresh), so the tokenizer runs about once
per distinct word of a task.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

CACHE = 400_000
TOKENIZER = "word_bpe_49k.json"
#: Letters whose lower case and composed form are one and the same letter in every Unicode library.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Marks that a plain word may end with; a run of them is a token of its own.
_MARKS = ".,!?;:*$%&#|()[]{}\"-+=/"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


class WordIds(dict):
    """Maps a word (UTF-8) to its ids (little-endian, 32 bits each)."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.rstrip(_MARKS)
        low = core.lower()
        if core and _PLAIN.fullmatch(low) and len(low) == len(core) and "İ" not in core and "K" not in core and "Å" not in core:
            if len(core) == len(text):
                letters = low.encode().decode("latin-1").translate(_LETTER)
                ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
            else:
                ids = self[low.encode()] + self[text[len(core):].encode()]
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # the tokenizer finds special tokens before it lowers the case
        words = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(self.__getitem__, words))


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def default_path() -> str:
    return public_tokenizers.path(TOKENIZER)
