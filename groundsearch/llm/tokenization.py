"""Token ids of whole texts, word by word.

Tokenizers that drop white space give a text the ids of its white-space-free words in turn, so a
worker encodes each word once and keeps it.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A stop mark between a usual letter or digit and white space: the pre-tokenizer parts it from the word.
_STOP = re.compile(r"[.,;:!?](?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff].)(?!\S)")


def _spaced(text: bytes) -> bytes:
    """text with blanks before such stops, and ASCII letters in lower case as the tokenizer has them; so fewer words differ."""
    if b"<|" in text:  # may name a special token
        return text
    return _STOP.sub(" \\g<0>", text.decode("utf-8", "replace")).encode().lower()


class WordEncoder:
    """Ids of texts under a tokenizers file whose pre-tokenizer drops white space."""

    #: Words kept, and the longest of them in bytes: some 200 MB at most.
    KEEP, LONGEST = 800_000, 48

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[bytes, bytes] = {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, packed as self.dtype."""
        split = [_spaced(t).split() for t in texts]
        kept = self.kept
        every = set(chain.from_iterable(split))
        fresh = every.difference(kept)
        if len(kept) + len(fresh) > self.KEEP:
            kept.clear()
            fresh = every
        letters = [w for w in fresh if w.isalpha()]
        others = [w for w in fresh if not w.isalpha()]
        accented = [w for w in others if w[0] > 64 and w.decode("utf-8", "replace").isalpha()]
        self._learn_letters(letters)
        self._learn_letters(accented)
        self._learn_each(list(set(others).difference(accented)))
        out = [b"".join(map(kept.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > self.LONGEST:
                del kept[w]
        return out

    def _learn_letters(self, words: list[bytes]) -> None:
        """Words that are one pre-token each, many in one text: the last id of each is one that ends a word."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):  # letters whose lower case has marks
                self._learn_each(some)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            begin = 0
            for w, end in zip(some, (ends * size).tolist(), strict=True):
                self.kept[w] = raw[begin:end]
                begin = end

    def _learn_each(self, words: list[bytes]) -> None:
        if words:
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
            self.kept.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(words, found, strict=True))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
