"""Token ids of a public vocabulary, encoded word by word with a bounded cache."""

from __future__ import annotations

import os
import re
from collections import ChainMap

import numpy as np

#: Words kept in a worker's cache, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 500_000, 48

#: Latin-1 letters in lower case, then ASCII marks other than the apostrophe.
_STOPPED = re.compile(r"([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]+)")

_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids as little-endian 32-bit bytes.

    For byte-level vocabularies whose pre-tokenizer lower-cases, drops white
    space, and never joins letters with anything else: a text's ids are those of its
    words in turn.  Latin-1 texts are lower-cased first (there that is the same
    character by character); their words of letters, with or without marks after them, go straight to
    the vocabulary's merges, all others through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        raw = np.arange(self.tokenizer.get_vocab_size(), dtype="<u4").tobytes()
        self.codes = [raw[k:k + 4] for k in range(0, len(raw), 4)]
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {k: bytewise.pre_tokenize_str(chr(k))[0][0] for k in range(128, 256)}
        self.cache: dict[str, bytes] = {"": b""}

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else []
        return {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(words, found)}

    def _letters(self, word: str) -> bytes:
        codes = self.codes
        return b"".join([codes[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])

    def _learn(self, latin: set[str], other: set[str]) -> dict[str, bytes]:
        """Ids of new words; ``latin``: of lower-cased Latin-1 texts."""
        out: dict[str, bytes] = {}
        known, letters, rest = self.cache, self._letters, list(other)
        stopped = []
        for w in latin:
            if w.isalpha():
                out[w] = letters(w)
            elif m := _STOPPED.fullmatch(w):
                stopped.append((w, m[1], m[2]))
            else:
                rest.append(w)
        out.update(self._whole(rest))
        out.update(self._whole(list({stop for _, _, stop in stopped}.difference(known, out))))
        for w, core, stop in stopped:
            ids = known.get(core) or out.get(core)
            if ids is None:
                ids = out[core] = letters(core)
            out[w] = ids + (known.get(stop) or out[stop])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        kinds = [_latin(x) for x in texts]
        split = [(x.lower() if k else x).replace("\n", " ").split(" ") for x, k in zip(texts, kinds)]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        latin = set().union(*(s for s, k in zip(split, kinds) if k)).difference(self.cache)
        other = set().union(*(s for s, k in zip(split, kinds) if not k)).difference(self.cache, latin)
        found = self._learn(latin, other)
        table = self.cache
        if any(len(w) > CACHE_CHARS for w in found):
            table = ChainMap(found, table)
            found = {w: ids for w, ids in found.items() if len(w) <= CACHE_CHARS}
        self.cache.update(found)
        return [b"".join(map(table.__getitem__, words)) for words in split]


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False
