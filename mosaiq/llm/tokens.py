"""Token ids of a public byte-level BPE, fast: words between single spaces are looked up in a bounded cache.

Ids equal those of ``tokenizers`` with add_special_tokens=False for the vocabulary's JSON file. A text that holds the
string of an added token is encoded by ``tokenizers`` itself, which gives that token's id; other texts go through
tiktoken with the file's own vocabulary as ranks. A blank always starts a new piece of the pre-tokeniser unless it
touches other white space, so a text whose blanks are single equals the chain of its blank-led words; other texts are
encoded whole.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

#: Words that one Python worker remembers.
CACHE_WORDS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Whole(Exception):
    """The text has white space that touches other white space."""


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Whole
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        return ids


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        added = {t["content"] for t in file["added_tokens"]}
        byte = _bytes_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(added)
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.bpe.encode_ordinary)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if not rest:
                raise _Whole
            if first and first[-1].isspace() or not first:
                raise _Whole
            return np.array(self.bpe.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))
        except _Whole:
            return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
