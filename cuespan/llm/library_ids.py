"""Token ids by the tokenizers library, each distinct piece of text encoded once.

The library itself takes about a second per megabyte; texts repeat their words,
so a worker remembers the ids of the pieces it has met. A piece is what lies
between white space, where no merge can cross, so its ids are those of the
library over the whole text. The memory of a worker is bounded: pieces met since
it was last full are kept, older ones go.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

from cuespan.llm.bpe import BYTE_PATTERN, Vocabulary, byte_letters

KNOWN_PIECES = 400_000
FEW = 200  # so many pieces of a call are not worth sorting out the words
LETTERS = dict(enumerate(byte_letters()))  # of a byte, for str.translate


class LibraryIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.vocab = Vocabulary(path)
        self.plain = Vocabulary(path).library
        self.plain.encode_special_tokens = True  # an added token in a text is a piece of its own
        self.splits = self.vocab.pattern.pattern == BYTE_PATTERN
        self.known: dict = {}
        self.older: dict = {}

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and ``end``."""
        cut = [self.vocab.chunks(t) for t in texts]
        known, older = self.known, self.older
        new = set().union(*cut).difference(known)
        for c in [c for c in new if c in older]:
            known[c] = older[c]
        new.difference_update(known)
        strings = {c for c in new if isinstance(c, str)}
        # letters and one other character behind them are a word each, so both are looked up
        halves = [c for c in strings if not c[-1].isalpha() and c[:-1].removeprefix(" ").isalpha()] if self.splits else []
        lone = strings.difference(halves)
        lone.update([c[:-1] for c in halves])
        lone.update({c[-1] for c in halves})
        lone.difference_update(known)
        for c in [c for c in lone if c in older]:
            known[c] = older[c]
        lone.difference_update(known)
        if self.splits and len(lone) > FEW:
            # letters behind a space or none are one word, which the library's model takes without cutting it
            words = [c for c in lone if c.removeprefix(" ").isalpha()]
            lone.difference_update(words)
            tokenize = self.plain.model.tokenize
            for c in words:
                letters = c.encode().decode("latin-1").translate(LETTERS)
                known[c] = array("I", [t.id for t in tokenize(letters)]).tobytes()  # four bytes, as workers are little-endian
        lone = list(lone)
        for c, e in zip(lone, self.plain.encode_batch_fast(lone, add_special_tokens=False), strict=True):
            known[c] = array("I", e.ids).tobytes()
        for c in halves:
            known[c] = known[c[:-1]] + known[c[-1]]
        for c in new.difference(strings):
            ids = [c] if isinstance(c, int) else [t.id for t in self.plain.model.tokenize(c[0])]
            known[c] = np.array(ids, "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, t)) + end for t in cut]
        if len(known) > KNOWN_PIECES:
            self.known, self.older = {}, known
        return out


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    """One per Python worker."""
    return LibraryIds(path)
