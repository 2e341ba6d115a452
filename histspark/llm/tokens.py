"""Token ids of whole texts by a public word-end BPE tokenizer, through a cache of white-space chunks.

The tokenizer never joins characters across white space, so the ids of a text are the ids of its chunks in order. A
task keeps the ids of recent chunks; a chunk of letters with plain punctuation behind goes to the BPE model directly,
any other chunk through the whole tokenizer.
"""

from __future__ import annotations

import string

import numpy as np
from tokenizers import Tokenizer

#: Chunks of one cache generation; two generations are held.
CACHE_CHUNKS = 500_000
#: A chunk longer than this is not kept.
LONGEST = 64
#: Behind letters a run of these is one piece of its own.
_TAIL = string.punctuation
#: Letters below this one are lowered alike everywhere.
_BEYOND = "\u0130"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: printable bytes stay, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class ChunkCache(dict):
    """Chunk (bytes) -> its ids as little-endian bytes; a miss is computed, an old generation is dropped."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.letters = _byte_letters()
        self.limit, self.older = limit, {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(chunk)
        if found is None:
            found = self._encode(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        stem = text.rstrip(_TAIL)
        if stem.isalpha() and max(stem) < _BEYOND:
            if len(stem) < len(text):
                return self[stem.encode()] + self[text[len(stem) :].encode()]
            lower = stem.lower()
            word = lower if lower.isascii() else "".join(map(self.letters.__getitem__, lower.encode()))
            return b"".join([self.packed[t.id] for t in self.model.tokenize(word)])
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as bytes of ``dtype``. The tokenizer lowers letters itself, so A-Z may be lowered first
        (for more hits), but not where a special token's text could arise."""
        raw = text.encode()
        if b"<|" not in raw:
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


_caches: dict[str, ChunkCache] = {}


def cache_for(path: str) -> ChunkCache:
    """The worker process's cache of a tokenizer file."""
    if path not in _caches:
        _caches[path] = ChunkCache(path)
    return _caches[path]
