"""Ids of a byte-level BPE tokenizer file, one dictionary look-up for each word that a worker has met before."""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import islice

from tokenizers import Tokenizer

#: The tokenizer's own word split, for texts of the characters below, where Python's classes agree with it.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")


class ByteBpe:
    """``packed(text)`` is the text's ids as little-endian unsigned 32-bit integers.

    Words don't interact in byte-level BPE, so ids are kept by word, for ``words`` words at most.
    When they are full the younger half goes, as frequent words are met early. Texts with characters outside Latin letters and
    printable ASCII are encoded whole by the tokenizer, whose Unicode tables may differ from Python's; so are texts that
    hold an added token's string (as ``<|endoftext|>``), which has an id of its own.
    """

    def __init__(self, path: str, words: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.words, self.known = words, {}
        # the format's letters for bytes: printable ones stand for themselves, the others follow from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.words:
            for word in list(islice(self.known, self.words // 2, None)):
                del self.known[word]
        tokenize, letters = self.model.tokenize, self.letters
        for word in words:
            ids = [token.id for token in tokenize(word.encode().decode("latin-1").translate(letters))]
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        if any(token in text for token in self.added) or _OTHER.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = _WORDS.findall(text)
        if new := set(words).difference(self.known):
            self._learn(new)
            if new := set(words).difference(self.known):
                self._learn(new)
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)
