"""Token ids of whole texts by a public word-level BPE, with a bounded cache of words.

The tokenizer drops white space and never merges across it, so a text's ids are the
ids of its space-separated chunks in order. Chunks repeat; each is encoded once per
worker and kept as the bytes of its ids. Chunks of plain Latin letters, digits and
punctuation are first cut into the tokenizer's own pre-tokens, which repeat even more;
any other chunk goes to the tokenizer as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from brightquay.llm.exchange import kept_by_worker

#: Characters whose lower case, composition and class are the same everywhere.
_PLAIN = re.compile("[!-~¡-¬®-ÿĀ-įı-ɏ]+")
#: The tokenizer's own pre-token pattern (fixed value).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Entries of each cache, about 200 bytes each; a full one is emptied.
CACHE = 600_000
#: Characters of texts that are split at once.
SLAB = 1 << 20


def default_tokenizer() -> str:
    """Place of the public tokenizer; operators take another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.most = cache
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        if len(self.pieces) + len(pieces) > self.most:
            self.pieces.clear()
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            enc = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, at = np.array(enc.ids, "<u4"), np.array(enc.word_ids)
            cuts = np.flatnonzero(np.diff(at)) + 1
            if len(cuts) + 1 == len(some):
                self.pieces.update(zip(some, (x.tobytes() for x in np.split(ids, cuts)), strict=True))
            else:
                self.pieces.update((p, self._ids(p)) for p in some)

    def _learn(self, chunks: set[str]) -> None:
        if len(self.chunks) + len(chunks) > self.most:
            self.chunks.clear()
        cut, other, known = {}, [], self.pieces.get
        for c in chunks:
            if _PLAIN.fullmatch(c) and "<|" not in c:
                low = c.lower()
                core = low.rstrip(".,")
                a, b = known(core), known(low[len(core) :], b"")
                if a is not None and (b or core is low) and core[-1:].isalpha():
                    self.chunks[c] = a + b  # a known word and its end mark
                else:
                    cut[c] = _PIECE.findall(low)
            else:
                other.append(c)
        new = list({p for ps in cut.values() for p in ps if p not in self.pieces})
        if new:
            if len(self.pieces) + len(new) > self.most:
                new = list({p for ps in cut.values() for p in ps})
            self._learn_pieces(new)
        get = self.pieces.__getitem__
        for c, ps in cut.items():
            self.chunks[c] = b"".join(map(get, ps))
        for c in other:
            self.chunks[c] = self._ids(c) if c else b""

    def _slab(self, texts: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        every = set().union(*words)
        new = every.difference(self.chunks)
        if new:
            if len(self.chunks) + len(new) > self.most:
                new = every
            self._learn(new)
        get = self.chunks.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in order; long texts go in slabs cut at white space."""
        held: list[str] = []
        size = 0
        for t in texts:
            if len(t) > SLAB:
                yield from self._slab(held)
                held, size = [], 0
                yield b"".join(x for part in _cut(t) for x in self._slab([part]))
                continue
            if size + len(t) > SLAB:
                yield from self._slab(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        yield from self._slab(held)


def _cut(text: str) -> Iterator[str]:
    at, white = 0, re.compile("[ \n]")
    while at < len(text):
        m = white.search(text, at + SLAB)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end + 1 if m else end


@functools.lru_cache(maxsize=1)
def word_ids(path: str, cache: int = CACHE) -> WordIds:
    """One encoder per worker and tokenizer file; other operators' tasks in the worker put it away."""
    kept_by_worker(word_ids.cache_clear)
    return WordIds(path, cache)
